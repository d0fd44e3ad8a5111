"""What the operators share: input tables, intermediate tables, streams of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.layout import durable_dir as new_path  # noqa: F401  (operators take them from here)
from textquarry.layout import stored, stored_meanwhile  # noqa: F401

#: Texts are handed to Python functions in slices of about so many bytes.
SLICE_BYTES = 4 << 20


def share(spark: SparkSession, value) -> Broadcast:
    """A broadcast of value as cloudpickle bytes. Spark pickles broadcast values by reference,
    so an object of this package's classes would need the package on every executor; as bytes
    made by cloudpickle, the classes of packages registered by value travel with it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared: Broadcast):
    """The value of a :func:`share` broadcast, in a task."""
    return cloudpickle.loads(shared.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The row of df as one struct named row, beside new columns that cannot clash with its names."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def training_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts take about the given bytes; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)
