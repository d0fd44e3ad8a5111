"""Stored postings, of trigrams or of terms."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

N_BUCKETS = 64
#: Lengths of texts in grams by which the postings of a token are ordered, and at which the
#: rounds of a search for the best texts end; the last round takes all longer texts.
LENGTH_EDGES = (64, 256, 1024, 4096, 16384, 65536, 262144)
#: Postings that a task groups at a time, at most so many bytes of them, and groups it passes on at a time.
BLOCK_POSTINGS, BLOCK_BYTES, BLOCKS_AT_ONCE = 1 << 20, 64 << 20, 1 << 14
PART, BAND, HELD = "__part", "__band", "__held_"
#: Stored postings take several times the space of their texts.
COMPRESSION = "zstd"


def posting_bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(N_BUCKETS)).cast("int")


def posting_bucket_ranges(rows: int, limit: int) -> list[tuple[int, int]]:
    """Ranges of buckets that hold about ``limit`` of so many postings each, but one bucket at least."""
    parts = min(max(1, -(-rows // limit)), N_BUCKETS)
    edges = [k * N_BUCKETS // parts for k in range(parts + 1)]
    return list(zip(edges, edges[1:]))


def write_postings(
    postings: DataFrame,
    path: str,
    files_per_bucket: int | None = None,
    token: str = "trigram",
    key: str = "doc_id",
    mode: str = "overwrite",
) -> None:
    """Store postings so that a search reads only the row groups and pages of its tokens.

    By default each task sorts the postings of the texts it read and writes them as one
    segment. Nothing is shuffled: postings take several times the space of their texts.
    Segments of new texts are simply appended.

    With ``files_per_bucket`` postings are shuffled into hash buckets of the token, so
    that a search opens a few files of the table only. A bucket is spread over that many
    tasks by document, so a bucket with a very common token is no hot spot. Within a token,
    postings are sorted by the band of the length of their text (``LENGTH_EDGES``) where they
    have one (``n_grams``), so that a search for the best texts, which reads the shortest first,
    skips the pages of the others.

    Blocks of postings of one token, not single ones, are shuffled and sorted, and spelled out
    as they are written. ``postings`` are either single ones, which each task groups first
    (:func:`group_postings`), or already such blocks (``build_postings(..., parts=...)``)."""
    if files_per_bucket is None:
        postings.sortWithinPartitions(token).write.mode(mode).parquet(path, compression=COMPRESSION)
        return
    postings = postings.drop("bucket")
    columns, blocks = postings.columns, postings
    if f"{HELD}{key}" in postings.columns:
        columns = [c.removeprefix(HELD) for c in postings.columns if c.startswith(HELD)] + [token]
    else:
        blocks = group_postings(postings, files_per_bucket, token, key)
    others = [c for c in columns if c != token]
    place = posting_bucket(F.col(token)) * files_per_bucket + F.pmod(PART, F.lit(files_per_bucket))
    blocks = (
        blocks.withColumn("__bucket", posting_bucket(F.col(token)))
        .repartitionById(N_BUCKETS * files_per_bucket, place)
        .sortWithinPartitions("__bucket", token, BAND)
    )
    rows = blocks.select("*", F.posexplode_outer(f"{HELD}{others[0]}").alias("__at", others[0]))
    spelled = {c: F.get(f"{HELD}{c}", F.col("__at")).alias(c) for c in others[1:]}
    rows = rows.select(*[spelled.get(c, F.col(c)) for c in columns], F.col("__bucket").alias("bucket"))
    with _in_given_order(postings.sparkSession):
        rows.write.partitionBy("bucket").mode(mode).parquet(path, compression=COMPRESSION)


def block_fields(token: T.StructField, others: Sequence[T.StructField]) -> T.StructType:
    """Blocks of postings: the part of the index that they belong to, their token, the band of
    lengths of their texts, and their other columns as arrays."""
    fields = [T.StructField(PART, T.IntegerType()), token, T.StructField(BAND, T.IntegerType())]
    return T.StructType(fields + [T.StructField(f"{HELD}{f.name}", T.ArrayType(f.dataType)) for f in others])


def part_of(key: str, parts: int) -> Column:
    """The part of a posting follows from its text's key, not from its block, so that a repeated
    task sends the same postings to each part."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def blocks_of(order: np.ndarray, starts: np.ndarray, heads, others: Sequence[pa.Array]) -> Iterator[pa.RecordBatch]:
    """Batches of blocks, given the order of the postings and where blocks start in it; ``heads``
    gives part, token and band of blocks by the numbers of their first postings."""
    ends = np.append(starts[1:], len(order))
    for at in range(0, len(starts), BLOCKS_AT_ONCE):
        first, last = starts[at : at + BLOCKS_AT_ONCE], ends[at : at + BLOCKS_AT_ONCE][-1]
        inside = pa.array(order[first[0] : last])
        offsets = pa.array(np.append(first, last) - first[0], pa.int32())
        out = [*heads(order[first]), *(pa.ListArray.from_arrays(offsets, c.take(inside)) for c in others)]
        yield pa.RecordBatch.from_arrays(out, [str(k) for k in range(len(out))])


def group_postings(postings: DataFrame, parts: int, token: str = "trigram", key: str = "doc_id") -> DataFrame:
    """Postings as blocks (:func:`block_fields`): one for each part, token and band of lengths
    among ``BLOCK_POSTINGS`` postings of a task."""
    others = [f for f in postings.schema if f.name != token]
    lengths = next((k for k, f in enumerate(others) if f.name == "n_grams"), None)

    def block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [pa.concat_arrays([b.column(k) for b in held]) for k in range(held[0].num_columns)]
        part, tokens, *rest = columns
        coded = tokens.dictionary_encode()
        band = np.zeros(len(part), np.int64)
        if lengths is not None:
            known = pc.fill_null(rest[lengths], 0).to_numpy(zero_copy_only=False)
            band = np.searchsorted(LENGTH_EDGES, known, side="right")
        group = part.to_numpy(zero_copy_only=False).astype(np.int64) * (len(coded.dictionary) + 1)
        group += pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False)
        group = group * (len(LENGTH_EDGES) + 1) + band
        order = np.argsort(group, kind="stable")
        group = group[order]
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        heads = lambda at: [part.take(pa.array(at)), tokens.take(pa.array(at)), pa.array(band[at], pa.int32())]
        yield from blocks_of(order, starts, heads, rest)

    def run(batches):
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= BLOCK_POSTINGS or size >= BLOCK_BYTES:
                yield from block(held)
                held, rows, size = [], 0, 0
        if rows:
            yield from block(held)

    named = postings.select(part_of(key, parts).alias(PART), token, *[f.name for f in others])
    return named.mapInArrow(run, block_fields(postings.schema[token], others))


@contextlib.contextmanager
def _in_given_order(spark: SparkSession):
    """Tasks hold one bucket each, in order; without open writers beside each other Spark would
    sort their rows by bucket once more."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, "0")
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def select_postings(
    postings: DataFrame, tokens: Sequence[str], token: str = "trigram"
) -> DataFrame:
    """Postings of the given tokens; prunes buckets where the table has them."""
    if "bucket" in postings.columns:
        wanted = [posting_bucket(F.lit(t)) for t in tokens]
        postings = postings.where(F.col("bucket").isin(wanted))
    return postings.where(F.col(token).isin(list(tokens)))
