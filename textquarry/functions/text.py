"""Words, English terms, word pairs and user names."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The published default stop words of the English analyser.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such "
    "that the their then there these they this to was will with"
).split()

# Letters, marks, digits and underscores, with apostrophes kept inside a word.
WORD_PATTERN = r"[\p{L}\p{M}\p{N}_]+(?:['\x{2019}][\p{L}\p{M}\p{N}_]+)*"
POSSESSIVE_PATTERN = r"['\x{2019}\x{FF07}]s$"


def words(text: Column) -> Column:
    """Lowercase words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def plain_terms(text: Column) -> Column:
    """English terms without stemming: no possessives, no stop words."""
    bare = F.transform(
        words(text),
        lambda w: F.when(w.endswith("s"), F.regexp_replace(w, POSSESSIVE_PATTERN, "")).otherwise(w),
    )
    return F.filter(bare, lambda w: ~w.isin(STOP_WORDS))


def english_terms(text: Column) -> Column:
    """English terms: :func:`plain_terms`, stemmed."""
    return stem_all(plain_terms(text))


def shingles(text: Column) -> Column:
    """Pairs of neighbouring lowercase words, without single words."""
    return word_pairs(words(text))


def word_pairs(tokens: Column) -> Column:
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), pairs),
        F.slice(tokens, F.lit(2), pairs),
        lambda left, right: F.concat_ws(" ", left, right),
    )


def normalize_username(name: Column) -> Column:
    """Strip one leading ``+``, ``%`` or ``@`` (unless nothing is left), lowercase."""
    return F.lower(F.regexp_replace(name, r"(?s)^[+%@]?(.+)$", "$1"))


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_all(terms: pa.Array) -> pa.Array:
    """Stem every term. Each distinct term of a batch is stemmed once, where it is, so no
    shuffle and no join with a vocabulary is needed."""
    flat = terms.flatten().dictionary_encode()
    stems = pa.array([porter_stem(t) for t in flat.dictionary.to_pylist()], pa.string())
    lengths = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = pa.array([0, *lengths.cumsum().tolist()], pa.int32())
    stemmed = stems.take(flat.indices)
    return pa.ListArray.from_arrays(offsets, stemmed, mask=terms.is_null())


# The suffix tables of Porter's published algorithm (1980), with the two
# later changes of his own programs ("bli" and "logi").
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
]
STEP3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
]
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]


def _shape(word: str) -> str:
    """``c``/``v`` for each letter; ``y`` is a vowel after a consonant."""
    shape = ""
    for at, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and at > 0 and shape[-1] == "c")
        shape += "v" if vowel else "c"
    return shape


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest_suffix(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter_stem(word: str) -> str:
    """Porter's suffix stripping (1980) of a lowercase word."""
    if len(word) <= 2:
        return word
    # Plurals.
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # Past tense and -ing.
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        suffix = _longest_suffix(word, ("ed", "ing"))
        if suffix and "v" in _shape(word[: -len(suffix)]):
            word = word[: -len(suffix)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c":
                word = word if word[-1] in "lsz" else word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    # Double and single suffixes.
    for table in (STEP2, STEP3):
        suffix = _longest_suffix(word, [s for s, _ in table])
        if suffix and _measure(word[: -len(suffix)]) > 0:
            word = word[: -len(suffix)] + dict(table)[suffix]
    suffix = _longest_suffix(word, STEP4)
    if suffix:
        stem = word[: -len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
            word = stem
    # Tidying up.
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
