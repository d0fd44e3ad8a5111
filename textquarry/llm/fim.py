"""Fill-in-the-middle: each text cut into prefix, middle and suffix, which are put out in another order.

A pyarrow.compute pipeline per batch: texts are split into lists of units, the lists are flattened
with their parent indices, each unit gets its ordinal in its text, units are filtered by role
(prefix, middle, suffix), the lists are rebuilt from the kept units and joined into pieces, and
the pieces are joined with the sentinels. Cut points and forms come from hashes of the id, which
Spark computes beside the text; no state crosses rows, so tasks need nothing but their batch.

Units are ``[A-Za-z]+`` runs or single other code points. To split a batch into them, a marker
that no text of the batch holds is put after each unit; the marker is chosen per batch among
private-use code points, and if every candidate occurs, the batch is split by Python's regex.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, table

# Fixed values of the transformation: unit pattern, sentinels, plain from this h3 remainder, spm below that h4 remainder.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM = 90
SPM_PERCENT = 20
SEED = "1"

_UNIT = re.compile(UNIT)
_MARKERS = [chr(c) for c in range(0xF0000, 0xF0400)]
_FORMS = ["plain", "psm", "spm"]
PLAIN, PSM, SPM = 0, 1, 2


def hash_part(seed: str, doc_id: Column, k: int) -> Column:
    """The k-th (0-based) group of 8 hex digits of sha256(seed:id) as an unsigned integer; a null id is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _units(texts: pa.Array) -> pa.ListArray:
    """Each text as a list of its units; a null text as an empty list."""
    texts = pc.fill_null(texts, "")
    for marker in _MARKERS:
        if not pc.any(pc.match_substring(texts, marker)).as_py():
            marked = pc.replace_substring_regex(texts, pattern=f"({UNIT})", replacement=f"\\1{marker}")
            parts = pc.split_pattern(marked, marker)
            # Each list ends with the empty string after the last marker.
            lengths = pc.subtract(pc.list_value_length(parts), 1)
            starts = parts.offsets.to_numpy()[:-1]
            flat = pc.list_flatten(parts)
            keep = np.ones(len(flat), bool)
            keep[(starts + lengths.to_numpy()).astype(np.int64)] = False
            return _rebuild(pc.filter(flat, pa.array(keep)), lengths.to_numpy().astype(np.int64))
    units = [_UNIT.findall(text) for text in texts.to_pylist()]
    return pa.array(units, pa.list_(pa.string()))


def _rebuild(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeListArray.from_arrays(pa.array(offsets), values)


def _pieces(units: pa.ListArray, first: np.ndarray, second: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Prefix, middle and suffix of each list: units before first, before second, and the rest."""
    flat = pc.list_flatten(units)
    parents = pc.list_parent_indices(units).to_numpy()
    starts = units.offsets.to_numpy()[:-1]
    ordinal = np.arange(len(flat), dtype=np.int64) - starts[parents]
    role = np.where(ordinal < first[parents], 0, np.where(ordinal < second[parents], 1, 2))
    out = []
    for r in range(3):
        chosen = role == r
        rebuilt = _rebuild(pc.filter(flat, pa.array(chosen)), np.bincount(parents[chosen], minlength=len(starts)))
        out.append(pc.binary_join(rebuilt, ""))
    return tuple(out)


def transform_batch(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> dict[str, pa.Array]:
    """n, form, the three pieces (null if plain) and the output text of each row."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    units = _units(texts)
    n = pc.list_value_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
    a = h1.to_numpy(zero_copy_only=False) % (n + 1)
    b = h2.to_numpy(zero_copy_only=False) % (n + 1)
    first, second = np.minimum(a, b), np.maximum(a, b)
    prefix, middle, suffix = _pieces(units, first, second)
    sentinel = pc.or_(pc.or_(pc.match_substring(texts, PREFIX), pc.match_substring(texts, SUFFIX)), pc.match_substring(texts, MIDDLE))
    plain = (n == 0) | sentinel.to_numpy(zero_copy_only=False) | (h3.to_numpy(zero_copy_only=False) % 100 >= PLAIN_FROM)
    form = np.where(plain, PLAIN, np.where(h4.to_numpy(zero_copy_only=False) % 100 < SPM_PERCENT, SPM, PSM))
    psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    output = pc.if_else(pa.array(form == PLAIN), texts, pc.if_else(pa.array(form == SPM), spm, psm))
    none = pa.array(form == PLAIN)
    return {
        "n": pa.array(n),
        "form": pc.take(pa.array(_FORMS), pa.array(form)),
        "prefix": pc.if_else(none, pa.scalar(None, pa.string()), prefix),
        "middle": pc.if_else(none, pa.scalar(None, pa.string()), middle),
        "suffix": pc.if_else(none, pa.scalar(None, pa.string()), suffix),
        "output": output,
    }


def restore_batch(output: pa.Array, form: pa.Array) -> pa.Array:
    """The text again from an output and its form: prefix, middle and suffix in order."""
    output = pc.fill_null(output, "")

    def cut(texts, lead, first, second):
        body = pc.utf8_slice_codeunits(texts, len(lead))
        one = pc.split_pattern(body, first, max_splits=1)
        left, rest = pc.list_element(one, 0), pc.binary_join(pc.list_slice(one, 1, 2), "")
        two = pc.split_pattern(rest, second, max_splits=1)
        return left, pc.list_element(two, 0), pc.binary_join(pc.list_slice(two, 1, 2), "")

    p, s, m = cut(output, PREFIX, SUFFIX, MIDDLE)
    psm = pc.binary_join_element_wise(p, m, s, "")
    s2, p2, m2 = cut(output, SUFFIX, PREFIX, MIDDLE)
    spm = pc.binary_join_element_wise(p2, m2, s2, "")
    return pc.if_else(pc.equal(form, "psm"), psm, pc.if_else(pc.equal(form, "spm"), spm, output))


def _mapper(batches):
    for batch in batches:
        for part in slices(batch, 1):
            columns = transform_batch(*[part.column(k) for k in range(1, 6)])
            yield pa.RecordBatch.from_arrays([part.column(0), *columns.values()], ["row", *columns])


def fill_in_middle(df: DataFrame, text: str = "text", id_column: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), seed: str = SEED) -> DataFrame:
    """One row per row of df: kept columns, n (units), form (plain, psm, spm), prefix, middle,
    suffix (null when plain) and output, the text to train on.

    A null text counts as empty and is plain; a text holding a sentinel is plain. A null id hashes
    as the empty string. Repeated rows each give their own equal row; extra columns are ignored
    unless kept, and may have any name; an empty table gives an empty table. Long texts are
    handled whole: a batch is cut into slices of bounded bytes, a longer text is a slice of its own.
    """
    ident = F.col(f"`{id_column}`")
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.col(f"`{text}`").cast("string").alias("text"),
        *[hash_part(seed, ident, k).alias(f"h{k + 1}") for k in range(4)],
    )
    schema = rows.select(
        "row",
        F.lit(0).cast("long").alias("n"),
        F.lit("").alias("form"),
        *[F.lit(None).cast("string").alias(c) for c in ("prefix", "middle", "suffix")],
        F.lit("").alias("output"),
    ).schema
    return rows.mapInArrow(_mapper, schema).select("row.*", "n", "form", "prefix", "middle", "suffix", "output")


def _restorer(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), restore_batch(batch.column(1), batch.column(2))], ["row", "restored"])


def restored(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The texts rebuilt from output and form, beside kept columns."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "output", "form")
    schema = rows.select("row", F.lit("").alias("restored")).schema
    return rows.mapInArrow(_restorer, schema).select("row.*", "restored")


def query(spark, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents"), keep=("doc_id",))
    chars = {c: F.when(F.col("form") != "plain", F.char_length(c)).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")}
    rows = cut.select("doc_id", "n", "form", chars["prefix"], chars["middle"], "output")
    back = restored(rows, keep=("doc_id", "n", "form", "prefix_chars", "middle_chars", "output"))
    return back.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units,
         ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2,
         ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4
  FROM d
), c AS (
  SELECT *, len(units) AS n,
         least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
         greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b
  FROM u
), p AS (
  SELECT doc_id, t, n,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:a], '') AS pre,
         array_to_string(units[a + 1:b], '') AS mid,
         array_to_string(units[b + 1:n], '') AS suf
  FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form = 'plain' THEN NULL ELSE CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form = 'plain' THEN NULL ELSE CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
