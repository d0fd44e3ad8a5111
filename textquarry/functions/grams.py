"""Trigrams of a text, and the trigram condition that a pattern implies.

The condition is only *necessary*: every text with a matching line satisfies it, so it
may be used to skip texts, never to decide a match. It is a small tree:

* ``True`` (says nothing) and ``False`` (nothing can match),
* ``frozenset`` of grams (at least one of them is present),
* ``("and", children)`` and ``("or", children)``.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions.patterns import LinePattern, fold_orbit

MAX_ALTERNATIVES = 16  # spelled-out variants of one part of a pattern
MAX_CLASS = 16  # larger character classes say nothing
MAX_VARIANTS = 64  # grams in one "any of" clause
MAX_REPEAT_COPIES = 4
MAX_GRAMS = 600  # grams in a whole condition

PIECE_LENGTH = 1 << 16  # characters of a long text taken at once
MERGED_PIECES = 64  # sets of pieces that are held before they become one
SLICE_BYTES = 1 << 20  # texts of a batch taken at once

ANYTHING = None  # a stretch of text of which nothing is known


def trigrams(text: Column) -> Column:
    """Distinct overlapping grams of three code points; none for shorter texts. Long
    texts are taken in pieces, so that a task never holds all their grams at once."""
    piece_at = F.sequence(
        F.lit(0), F.floor((F.length(text) - 1) / PIECE_LENGTH).cast("int")
    )
    pieces = F.transform(
        piece_at, lambda i: F.substr(text, i * PIECE_LENGTH + 1, F.lit(PIECE_LENGTH + 2))
    )
    of_pieces = F.flatten(F.transform(pieces, _grams_of))
    return F.when(F.length(text) <= PIECE_LENGTH, _grams_of(text)).otherwise(
        F.array_distinct(of_pieces)
    )


def _grams_of(text: Column) -> Column:
    # Each match takes one code point, so the next never starts inside a surrogate pair.
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))."), F.lit(1)))


def packed_trigrams(text: str | None) -> np.ndarray:
    """Distinct trigrams of a text, sorted, three code points of 21 bits in a number each. A long
    text is taken in pieces, so that only one piece's grams with their repeats are held."""
    low, mid = np.uint64(21), np.uint64(42)
    points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
    parts = []
    for at in range(0, max(len(points) - 2, 0), PIECE_LENGTH):
        codes = points[at : at + PIECE_LENGTH + 2].astype(np.uint64)
        parts.append(_sorted_distinct(codes[:-2] << mid | codes[1:-1] << low | codes[2:]))
        if len(parts) == MERGED_PIECES:
            parts = [_sorted_distinct(np.concatenate(parts))]
    if len(parts) == 1:
        return parts[0]
    return _sorted_distinct(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _sorted_distinct(numbers: np.ndarray) -> np.ndarray:
    """Measured, twice as fast as numpy's unique, which hashes first."""
    numbers.sort()
    return numbers[np.append(True, numbers[1:] != numbers[:-1])]


def unpacked_trigrams(packed: np.ndarray) -> pa.StringArray:
    """The strings of packed trigrams."""
    low, mid, mask = np.uint64(21), np.uint64(42), np.uint64((1 << 21) - 1)
    codes = np.empty((len(packed), 3), np.uint32)
    for place, part in enumerate((packed >> mid, packed >> low & mask, packed & mask)):
        codes[:, place] = part
    # A gram's length in UTF-8 gives its place in the joined text of all grams.
    sizes = np.full(len(packed), 3, np.int32)
    for limit in (0x7F, 0x7FF, 0xFFFF):
        sizes += (codes > limit).sum(1, dtype=np.int32)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    joined = codes.tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(packed), pa.py_buffer(ends), pa.py_buffer(joined))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[slice]:
    """Consecutive parts of an array whose texts take about the given bytes; a longer text is a
    part of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for at, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield slice(start, at)
            start, held = at, 0
        held += size
    if start < len(texts):
        yield slice(start, len(texts))


@F.arrow_udf(T.ArrayType(T.StringType()))
def distinct_trigrams(texts: pa.Array) -> pa.Array:
    """The same as :func:`trigrams`, sorted. Texts are taken in slices of bounded size."""
    done = []
    for part in text_slices(texts):
        sets = [packed_trigrams(text.as_py()) for text in texts[part]]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32())
        grams = unpacked_trigrams(np.concatenate(sets))
        done.append(pa.ListArray.from_arrays(offsets, grams, mask=texts[part].is_null()))
    return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.string()))


def _all_of(children: Iterable) -> object:
    kept: list = []
    for child in children:
        if child is False:
            return False
        parts = child[1] if isinstance(child, tuple) and child[0] == "and" else [child]
        kept += [p for p in parts if p is not True and p not in kept]
    clauses = [c for c in kept if isinstance(c, frozenset)]
    kept = [c for c in kept if not any(isinstance(c, frozenset) and o < c for o in clauses)]
    if not kept:
        return True
    return kept[0] if len(kept) == 1 else ("and", tuple(kept))


def _any_of(children: Iterable) -> object:
    kept: list = []
    for child in children:
        if child is True:
            return True
        if child is not False and child not in kept:
            kept.append(child)
    if not kept:
        return False
    if all(isinstance(c, frozenset) for c in kept):
        merged = frozenset().union(*kept)
        if len(merged) <= MAX_VARIANTS:
            return merged
    return kept[0] if len(kept) == 1 else ("or", tuple(kept))


class _Known:
    """A stretch of text of unknown spelling that satisfies a condition."""

    def __init__(self, condition):
        self.condition = condition


def _condition(alternatives: list[list]) -> object:
    """Condition of a part of a pattern that is spelled in one of these ways."""
    return _any_of(_all_of(_sequence_clauses(sequence)) for sequence in alternatives)


def _sequence_clauses(sequence: list) -> Iterable:
    for item in sequence:
        if isinstance(item, _Known):
            yield item.condition
    for window in zip(sequence, sequence[1:], sequence[2:]):
        if all(isinstance(chars, frozenset) for chars in window):
            a, b, c = window
            if len(a) * len(b) * len(c) <= MAX_VARIANTS:
                yield frozenset(map("".join, itertools.product(a, b, c)))


def _class_members(items: list, fold: bool) -> frozenset[str] | None:
    members: set[str] = set()
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            members.add(chr(value))
        elif name == "RANGE" and value[1] - value[0] < MAX_CLASS:
            members.update(map(chr, range(value[0], value[1] + 1)))
        else:
            return ANYTHING
    if fold:
        members = set().union(*(fold_orbit(c) for c in members))
    return frozenset(members) if len(members) <= MAX_CLASS else ANYTHING


def _join(left: list[list], right: list[list]) -> list[list]:
    if len(left) * len(right) > MAX_ALTERNATIVES:
        return [[_Known(_condition(left)), _Known(_condition(right))]]
    return [a + b for a in left for b in right]


def _spellings(nodes, fold: bool) -> list[list]:
    """The ways in which a parsed pattern can be spelled, as far as they are known."""
    found: list[list] = [[]]
    for op, value in nodes:
        name = str(op)
        if name == "LITERAL":
            part = [[fold_orbit(chr(value)) if fold else frozenset(chr(value))]]
        elif name == "IN":
            part = [[_class_members(value, fold)]]
        elif name == "AT":
            part = [[]]
        elif name == "FAILURE":
            part = []
        elif name == "SUBPATTERN":
            _, added, removed, body = value
            ignore = 2  # the re.IGNORECASE bit
            part = _spellings(body, (fold or bool(added & ignore)) and not removed & ignore)
        elif name == "BRANCH":
            part = [s for body in value[1] for s in _spellings(body, fold)]
            if len(part) > MAX_ALTERNATIVES:
                part = [[_Known(_condition(part))]]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            part = _repeated(*value, fold)
        else:
            part = [[ANYTHING]]
        found = _join(found, part)
    return found


def _repeated(low: int, high: int, body, fold: bool) -> list[list]:
    once = _spellings(body, fold)
    if low == 0:
        return once + [[]] if high == 1 and len(once) < MAX_ALTERNATIVES else [[ANYTHING]]
    head: list[list] = [[]]
    for _ in range(min(low, MAX_REPEAT_COPIES)):
        head = _join(head, once)
    if low == high and low <= MAX_REPEAT_COPIES:
        return head
    # First copies, then anything, then the last copy: both ends keep their neighbours.
    return _join(_join(head, [[ANYTHING]]), once)


def grams_in(condition: object) -> frozenset[str]:
    if isinstance(condition, bool):
        return frozenset()
    if isinstance(condition, frozenset):
        return condition
    return frozenset().union(*(grams_in(child) for child in condition[1]))


def _bounded(condition: object, budget: int) -> object:
    """Weaken a condition until it names at most ``budget`` grams."""
    if isinstance(condition, bool) or len(grams_in(condition)) <= budget:
        return condition
    if isinstance(condition, frozenset) or condition[0] == "or":
        return True
    kept: list = []
    for child in sorted(condition[1], key=lambda c: len(grams_in(c))):
        if len(grams_in(_all_of([*kept, child]))) <= budget:
            kept.append(child)
    return _all_of(kept)


def gram_condition(pattern: LinePattern) -> object:
    """The trigram condition that every text with a matching line satisfies."""
    if pattern.parsed is None:
        return True
    return _bounded(_condition(_spellings(pattern.parsed, False)), MAX_GRAMS)


def required_literals(pattern: LinePattern, most: int = 4) -> list[str]:
    """Strings of which every matching line holds at least one; empty if there is no
    short such list. Plain string search is far cheaper than a pattern."""
    if pattern.parsed is None:
        return []
    longest: list[str] = []
    for spelling in _spellings(pattern.parsed, False):
        runs = [""]
        for item in spelling:
            single = isinstance(item, frozenset) and len(item) == 1
            runs.append(runs[-1] + next(iter(item)) if single else "")
        longest.append(max(runs, key=len))
    literals = sorted(set(longest))
    if not literals or len(literals) > most or min(map(len, literals)) < 2:
        return []
    return literals


def rarest(condition: object, frequency: Mapping[str, int], keep: int) -> object:
    """Keep the ``keep`` most selective terms of every AND. Dropping terms of an AND
    only weakens the condition, so no match is lost."""
    if isinstance(condition, (bool, frozenset)):
        return condition
    children = [rarest(child, frequency, keep) for child in condition[1]]
    if condition[0] == "or":
        return _any_of(children)
    cost = lambda child: sum(frequency.get(g, 0) for g in grams_in(child))
    return _all_of(sorted(children, key=cost)[:keep])


def most_texts(condition: object, frequency: Mapping[str, int]) -> int:
    """How many texts can satisfy a condition, at most, given in how many each gram is."""
    if isinstance(condition, frozenset):
        return sum(frequency.get(g, 0) for g in condition)
    bounds = [most_texts(child, frequency) for child in condition[1]]
    return min(bounds) if condition[0] == "and" else sum(bounds)


def condition_column(condition: object, any_present: Callable[[frozenset], Column]) -> Column:
    """The condition as a boolean column, given a test for "one of these grams"."""
    if isinstance(condition, bool):
        return F.lit(condition)
    if isinstance(condition, frozenset):
        return any_present(condition)
    parts = [condition_column(child, any_present) for child in condition[1]]
    out = parts[0]
    for part in parts[1:]:
        out = out & part if condition[0] == "and" else out | part
    return out
