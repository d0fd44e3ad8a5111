"""Exact dedup by content sort.

Rows are range-partitioned by the first bytes of their normalised texts, the digest of all bytes
and the id, at splitters that Spark samples, and sorted externally within each partition. Equal
texts are then neighbours; each row is compared with the one before it over all its bytes. The
id is part of the order, so that a group of copies of any size is cut over many partitions; the
at most two groups of a partition that may go on in another are joined by their digests.

The key holds a bounded number of bytes, as Spark sends sampled keys to the driver.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

#: Leading bytes of the normalised text in the sort key.
KEY_BYTES = 32
WHITE_SPACE = r"[\x20\x09-\x0D]+"

FIRST, LAST = 1, 2

_RUN = [("keep_id", T.LongType()), ("group_size", T.LongType()), ("position", T.LongType()), ("digest", T.StringType()), ("part", T.IntegerType()), ("edge", T.IntegerType())]


def normalised(text):
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE_SPACE, " ")


def _sorted(df: DataFrame, id_column: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{id_column}`").cast("long").alias("id"), normalised(F.col(f"`{text}`")).alias("norm"))
    rows = rows.select("row", "id", "norm", F.sha2("norm", 256).alias("digest"))
    key = F.substring(F.col("norm").cast("binary"), 1, KEY_BYTES)
    rows = rows.withColumn("start", key)
    order = [F.col("start"), F.col("digest"), F.col("id").asc_nulls_last()]
    return rows.repartitionByRange(*order).sortWithinPartitions("start", "digest", "norm", F.col("id").asc_nulls_last()).select("row", "id", "norm", "digest")


class _Runs:
    """Runs of equal neighbours in one sorted partition. Of the run that is still open only its
    head and, if all members are wanted, their kept columns are held."""

    def __init__(self, heads_only: bool):
        self.heads_only, self.part = heads_only, TaskContext.get().partitionId()
        self.last, self.head, self.members, self.size, self.first = None, None, [], 0, FIRST

    def close(self, edge: int) -> list[pa.RecordBatch]:
        if self.head is None:
            return []
        members = [self.head.column(0)] if self.heads_only else self.members
        row = pa.concat_arrays(members)
        out = self.out(row, pa.array(range(len(row)), pa.int64()), [0] * len(row), self.head, [self.size], self.first | edge)
        self.first, self.head, self.members, self.size = 0, None, [], 0
        return [out]

    def out(self, row, position, of, heads, sizes, edge) -> pa.RecordBatch:
        take = pa.array(of, pa.int64())
        n = len(row)
        return pa.RecordBatch.from_arrays(
            [row, heads.column(1).take(take), pa.array(sizes, pa.int64()).take(take), position, heads.column(3).take(take), pa.array([self.part] * n, pa.int32()), pa.array([edge] * n, pa.int32())],
            ["row", *[name for name, _ in _RUN]],
        )

    def hold(self, batch: pa.RecordBatch) -> None:
        if not self.heads_only:
            # A copy, as a slice would keep the texts of its whole batch.
            self.members.append(_copied(batch.select([0])).column(0))
        self.size += batch.num_rows

    def add(self, batch: pa.RecordBatch):
        """Batches of the rows of the runs that end in this batch."""
        norm, n = batch.column(2), batch.num_rows
        starts = (pc.indices_nonzero(pc.invert(pc.equal(norm.slice(1), norm.slice(0, n - 1)))).to_numpy() + 1).tolist()
        if self.head is None or norm[0].as_py() != self.last:
            starts.insert(0, 0)
        self.last = norm[n - 1].as_py()
        if not starts:
            return self.hold(batch)
        if starts[0] or self.head is not None:
            if starts[0]:
                self.hold(batch.slice(0, starts[0]))
            yield from self.close(0)
        if len(starts) > 1 and self.first:  # the partition's first run ends here
            self.head = _copied(batch.slice(starts[0], 1))
            self.hold(batch.slice(starts[0], starts[1] - starts[0]))
            yield from self.close(0)
            starts = starts[1:]
        if len(starts) > 1:
            sizes = [b - a for a, b in zip(starts, starts[1:])]
            heads = batch.take(pa.array(starts[:-1], pa.int64()))
            if self.heads_only:
                yield self.out(heads.column(0), pa.array([0] * len(sizes), pa.int64()), range(len(sizes)), heads, sizes, 0)
            else:
                row = batch.column(0).slice(starts[0], starts[-1] - starts[0])
                position = pa.array([k for size in sizes for k in range(size)], pa.int64())
                yield self.out(row, position, [k for k, size in enumerate(sizes) for _ in range(size)], heads, sizes, 0)
        self.head = _copied(batch.slice(starts[-1], 1))
        self.hold(batch.slice(starts[-1]))


def _copied(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A copy that does not keep the whole batch in memory."""
    return batch.take(pa.array(range(batch.num_rows), pa.int64()))


def _find_runs(heads_only: bool):
    def run(batches):
        runs = _Runs(heads_only)
        for batch in batches:
            if batch.num_rows:
                yield from runs.add(batch) or ()
        yield from runs.close(LAST)

    return run


def _runs(df: DataFrame, id_column: str, text: str, keep: tuple[str, ...], heads_only: bool) -> DataFrame:
    """Rows with their run; those of runs at the edge of a partition with what all parts of the run make."""
    rows = _sorted(df, id_column, text, keep)
    schema = T.StructType([rows.schema["row"], *[T.StructField(name, kind) for name, kind in _RUN]])
    rows = stored(rows.mapInArrow(_find_runs(heads_only), schema), "content-runs")
    edges = rows.filter((F.col("edge") > 0) & (F.col("position") == 0)).groupBy(F.col("digest").alias("edge_digest")).agg(F.min("keep_id").alias("edge_id"), F.sum("group_size").alias("edge_size"), F.min("part").alias("edge_part"))
    # At most two rows a partition.
    return rows.join(F.broadcast(edges), (F.col("edge") > 0) & (F.col("digest") == F.col("edge_digest")), "left")


def exact_groups(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Rows are equal when their normalised texts are; null counts as empty. The row with the smallest
    id stays; of rows that also share the id one stays. Rows without an id come after all others,
    and keep_id is null only if no row of the group has one. Extra columns are ignored.
    """
    rows = _runs(df, id_column, text, (id_column,), heads_only=False)
    return rows.select(
        F.col("row").getField(id_column).alias(id_column),
        F.coalesce("edge_id", "keep_id").alias("keep_id"),
        F.coalesce("edge_size", "group_size").alias("group_size"),
        ((F.col("position") == 0) & (F.coalesce("edge_part", "part") == F.col("part"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that exact_groups keeps, with all columns of df, whatever their names."""
    rows = _runs(df, id_column, text, tuple(df.columns), heads_only=True)
    rows = rows.filter(F.coalesce("edge_part", "part") == F.col("part"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
    WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
    FROM norm WINDOW same AS (PARTITION BY t)
"""
