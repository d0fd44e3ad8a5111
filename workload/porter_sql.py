"""Porter's stemmer as SQL: each step one SELECT, his measure a regular expression.

A ``y`` after a consonant is a vowel; it is written ``Y`` until the end."""

from __future__ import annotations

from textquarry.functions.text import STEP2, STEP3, STEP4

_V, _C = "[aeiouY]", "[^aeiouY]"


def _measure(stem: str, more_than: int) -> str:
    return f"regexp_matches({stem}, '^{_C}*({_V}+{_C}+){{{more_than + 1}}}')"


def _measure_is_one(stem: str) -> str:
    return f"({_measure(stem, 0)} AND NOT {_measure(stem, 1)})"


def _vowel(stem: str) -> str:
    return f"regexp_matches({stem}, '{_V}')"


def _short_end(stem: str) -> str:
    return f"regexp_matches({stem}, '{_C}{_V}[^aeiouYwxy]$')"


def _cut(n: int, word: str = "w") -> str:
    return f"left({word}, length({word}) - {n})"


def _endings(pairs: list[tuple[str, str]], holds) -> str:
    """The longest ending decides, whether its condition holds or not."""
    cases = "".join(
        f"WHEN suffix(w, '{end}') THEN CASE WHEN {holds(_cut(len(end)), end)} THEN {_cut(len(end))} || '{new}' ELSE w END "
        for end, new in sorted(pairs, key=lambda p: -len(p[0]))
    )
    return f"CASE {cases} ELSE w END"


def stems_sql(terms: str) -> str:
    """``term`` and ``stem`` of a query with distinct lowercase terms in ``term``."""
    past = "CASE WHEN suffix(w, 'ing') THEN 3 WHEN suffix(w, 'ed') AND NOT suffix(w, 'eed') THEN 2 ELSE 0 END"
    steps = [
        "CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN " + _cut(2)
        + " WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN " + _cut(1) + " ELSE w END",
        # The marker keeps apart what has lost an ending.
        f"""CASE WHEN suffix(w, 'eed') THEN CASE WHEN {_measure(_cut(3), 0)} THEN {_cut(1)} ELSE w END
                 WHEN ({past}) > 0 AND {_vowel(f"left(w, length(w) - ({past}))")}
                 THEN left(w, length(w) - ({past})) || '|' ELSE w END""",
        f"""CASE WHEN NOT suffix(w, '|') THEN w
                 WHEN regexp_matches(w, '(at|bl|iz)\\|$') THEN {_cut(1)} || 'e'
                 WHEN length(w) > 2 AND substr(w, -2, 1) = substr(w, -3, 1) AND regexp_matches(w, '{_C}\\|$')
                 THEN CASE WHEN regexp_matches(w, '[lsz]\\|$') THEN {_cut(1)} ELSE {_cut(2)} END
                 WHEN {_measure_is_one(_cut(1))} AND {_short_end(_cut(1))} THEN {_cut(1)} || 'e'
                 ELSE {_cut(1)} END""",
        f"CASE WHEN regexp_matches(w, '[yY]$') AND {_vowel(_cut(1))} THEN {_cut(1)} || 'i' ELSE w END",
        _endings(STEP2, lambda stem, end: _measure(stem, 0)),
        _endings(STEP3, lambda stem, end: _measure(stem, 0)),
        _endings(
            [(end, "") for end in STEP4],
            lambda stem, end: _measure(stem, 1) + (f" AND regexp_matches({stem}, '[st]$')" if end == "ion" else ""),
        ),
        f"""CASE WHEN suffix(w, 'e') AND ({_measure(_cut(1), 1)}
                      OR ({_measure_is_one(_cut(1))} AND NOT {_short_end(_cut(1))})) THEN {_cut(1)} ELSE w END""",
        f"CASE WHEN suffix(w, 'll') AND {_measure('w', 1)} THEN {_cut(1)} ELSE w END",
    ]
    query = f"SELECT term, regexp_replace(term, '([^aeiouyY])y', '\\1Y', 'g') AS w FROM ({terms})"
    for step in steps:
        query = f"SELECT term, CASE WHEN length(term) <= 2 THEN w ELSE {step} END AS w FROM ({query})"
    return f"SELECT term, replace(w, 'Y', 'y') AS stem FROM ({query})"
