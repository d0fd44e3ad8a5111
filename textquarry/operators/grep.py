"""Line search: matching lines, matching files, printed form and summary.

Everything here is narrow: a text is tested, split into lines and filtered where it is
read. No operator shuffles but :func:`search_summary` (one row). On RE2, one function per
Arrow batch splits and matches, so only hits come back and no row is made per line.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions.grams import required_literals, text_slices
from textquarry.functions.patterns import LinePattern, compile_pattern

ENGINES = ("auto", "java", "re2")
#: Texts that are split into lines at a time.
SLICE_BYTES = 4 << 20


def re2_matches(regex: str, text: Column) -> Column:
    """Linear-time RE2 test over Arrow batches, for patterns unsafe to backtrack on."""

    @F.arrow_udf("boolean")
    def matches(values: pa.Array) -> pa.Array:
        return pc.match_substring_regex(values, pattern=regex)

    return matches(text)


def _engine_for(engine: str) -> str:
    if engine not in ENGINES:
        raise ValueError(f"engine must be one of {ENGINES}, not {engine!r}")
    # Measured, RE2 by batches is as fast or up to twice as fast on every kind of pattern.
    return "re2" if engine == "auto" else engine


def split_lines(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """One row per line with ``line_no`` from 1, ``line`` and ``ends_text`` (the text ends
    here, without a newline). A final newline starts no further line.

    The outer form of the generator is used, here and elsewhere, because Spark guards the
    plain one with a filter that would split every text two more times."""
    pieces = docs.select(*keep, F.split(F.col(text), "\n", -1).alias("pieces"))
    exploded = pieces.select(
        *keep, F.size("pieces").alias("n_pieces"), F.posexplode_outer("pieces").alias("at", "line")
    )
    at_end = F.col("at") == F.col("n_pieces") - 1
    real = F.col("line").isNotNull() & (~at_end | (F.col("line") != ""))
    return exploded.where(real).select(
        *keep, (F.col("at") + 1).alias("line_no"), "line", at_end.alias("ends_text")
    )


def _place_regexes(pattern: LinePattern) -> dict[tuple[bool, bool], str]:
    """The regex for a line by whether it is the text's first and its last; one for all
    lines, under (False, False), if the pattern has no text anchor."""
    places = [(a, b) for a in (False, True) for b in (False, True)]
    places = places if pattern.has_text_anchor else places[:1]
    return {(a, b): pattern.re2_line_regex(first=a, last=b) for a, b in places}


def _sliced(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches in parts of bounded bytes of text, as lines are copied several times over."""
    for batch in batches:
        for part in text_slices(batch.column(text), SLICE_BYTES):
            yield batch.slice(part.start, part.stop - part.start)


def _hits_of(texts: pa.Array, regexes: dict) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Matching lines of a batch of texts: index of the text, line number, line."""
    pieces = pc.split_pattern(texts, "\n")
    lines, parent = pc.list_flatten(pieces), pc.list_parent_indices(pieces).to_numpy()
    counts = np.bincount(parent, minlength=len(texts)) if len(parent) else np.zeros(len(texts), int)
    number = np.arange(len(parent)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    first, last = number == 1, number == counts[parent]
    empty = pc.equal(pc.binary_length(lines), 0).to_numpy(zero_copy_only=False)
    real = ~(last & empty)
    found = np.zeros(len(parent), bool)
    for (at_first, at_last), regex in regexes.items():
        where = real & (first == at_first) & (last == at_last) if len(regexes) > 1 else real
        at = np.flatnonzero(where)
        held = lines if len(at) == len(parent) else lines.take(pa.array(at))
        test = pc.match_substring_regex(held, pattern=regex)
        found[at[test.to_numpy(zero_copy_only=False)]] = True
    at = np.flatnonzero(found)
    return parent[at], number[at], lines.take(pa.array(at))


def _re2_lines(docs: DataFrame, pattern: LinePattern, text: str, keep: Sequence[str]) -> DataFrame:
    """``keep``, ``line_no`` and ``line`` of every line that RE2 matches."""
    regexes = _place_regexes(pattern)

    def run(batches):
        for batch in _sliced(batches, len(keep)):
            parent, number, line = _hits_of(batch.column(len(keep)), regexes)
            if len(parent):
                taken = [batch.column(k).take(pa.array(parent)) for k in range(len(keep))]
                columns = [*taken, pa.array(number, pa.int32()), line]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "line_no", "line"])

    fields = [docs.schema[k] for k in keep]
    fields += [T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType())]
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, T.StructType(fields))


def _re2_texts(docs: DataFrame, pattern: LinePattern, text: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` of every text with a line that RE2 matches, once a text."""
    regexes = _place_regexes(pattern)

    def run(batches):
        for batch in _sliced(batches, len(keep)):
            parent = np.unique(_hits_of(batch.column(len(keep)), regexes)[0])
            if len(parent):
                taken = [batch.column(k).take(pa.array(parent)) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays(taken, list(keep))

    schema = T.StructType([docs.schema[k] for k in keep])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def line_matches(pattern: LinePattern, engine: str = "java") -> Column:
    """Test of the ``line`` column of :func:`split_lines`."""
    line, first, last = F.col("line"), F.col("line_no") == 1, F.col("ends_text")

    def test(**position) -> Column:
        if engine == "re2":
            return re2_matches(pattern.re2_line_regex(**position), line)
        return line.rlike(pattern.line_regex(**position))

    if not pattern.has_text_anchor:
        return test()
    return (
        F.when(first & last, test(first=True, last=True))
        .when(first, test(first=True))
        .when(last, test(last=True))
        .otherwise(test())
    )


def _with_literals(docs: DataFrame, pattern: LinePattern, text: str) -> DataFrame:
    """Texts that hold a string without which no line matches. Measured, this is worth
    its cost; testing whole texts with the pattern before their lines is not."""
    tests = [F.contains(text, F.lit(literal)) for literal in required_literals(pattern)]
    return docs.where(functools.reduce(operator.or_, tests)) if tests else docs


def grep(
    docs: DataFrame,
    pattern: str,
    ignore_case: bool = False,
    line_numbers: bool = True,
    text: str = "data",
    keep: Sequence[str] = ("doc_id", "name"),
    engine: str = "auto",
) -> DataFrame:
    """Every line with a match. A match never spans lines."""
    compiled = compile_pattern(pattern, ignore_case)
    engine = _engine_for(engine)
    docs = _with_literals(docs, compiled, text)
    if engine == "re2":
        matched = _re2_lines(docs, compiled, text, keep)
    else:
        matched = split_lines(docs, text, keep).where(line_matches(compiled))
    return matched.select(*keep, *(["line_no"] if line_numbers else []), "line")


def grep_files(
    docs: DataFrame,
    pattern: str,
    ignore_case: bool = False,
    text: str = "data",
    keep: Sequence[str] = ("doc_id", "name"),
    engine: str = "auto",
) -> DataFrame:
    """Texts with any matching line, each once for every row of ``docs`` that has it;
    nothing is exploded or shuffled."""
    compiled = compile_pattern(pattern, ignore_case)
    engine = _engine_for(engine)
    whole = F.col(text)
    if engine == "re2":
        if compiled.text_test_is_exact and not compiled.has_text_anchor:
            docs = _with_literals(docs, compiled, text)
            flags = "(?m)" + ("(?i)" if ignore_case else "")
            return docs.where(re2_matches(flags + pattern, whole)).select(*keep)
        return _re2_texts(_with_literals(docs, compiled, text), compiled, text, keep)
    docs = _with_literals(docs, compiled, text)
    if compiled.text_test_is_exact:
        return docs.where(whole.rlike(compiled.text_regex)).select(*keep)
    pieces = F.split(whole, "\n", -1)
    if not compiled.has_text_anchor:
        regex = compiled.line_regex()
        real = F.when(whole.endswith("\n"), F.slice(pieces, F.lit(1), F.size(pieces) - 1))
        lines = F.when(whole != "", real.otherwise(pieces))
        return docs.where(F.exists(lines, lambda line: line.rlike(regex))).select(*keep)
    return _re2_texts(docs, compiled, text, keep)


def format_matches(
    matches: DataFrame, names: bool = True, numbers: bool = False, name: str = "name"
) -> DataFrame:
    """Printed form of matches, ``name:N:line``; both prefixes are optional."""
    parts = [F.col(name)] if names else []
    parts += [F.col("line_no").cast("string")] if numbers else []
    return matches.withColumn("printed", F.concat_ws(":", *parts, F.col("line")))


def search_summary(candidates: DataFrame, matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: number of candidates, and of candidates with a match. ``matches`` holds
    rows of candidates only, any number of them per candidate."""
    return (
        candidates.agg(F.count("*").alias("candidates"))
        .withColumn(
            "matched_files",
            matches.agg(F.count_distinct(key).alias("matched_files")).scalar(),
        )
    )
