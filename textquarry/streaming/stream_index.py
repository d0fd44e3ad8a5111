"""Keep a document table up to date as files arrive.

The table is a log: every micro-batch writes its documents under ``batch=<id>``, and
writes the same place again when it is replayed, so a restart adds nothing twice.
Readers take the latest version of each document. ``compact`` folds the log into a new
base table.

The file source sees new paths only, and none that start with ``.`` or ``_``. Those, and
changed and removed files, are found by ``changed_paths`` and ``drop_missing``, run as a
scheduled batch over a listing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textquarry.operators.documents import seen_files, to_documents
from textquarry.operators.filters import MAX_FILE_SIZE, drop_reason
from textquarry.sources.archives import expand_archives

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, directory: str, files_per_trigger: int = 100_000) -> DataFrame:
    """New files of a tree as a stream."""
    return (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(directory)
    )


def files_to_documents(files: DataFrame, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """Documents of plain ``binaryFile`` rows, archives expanded and filters applied."""
    rows = files.selectExpr(
        "regexp_replace(path, '^file:/+', '/') AS path",
        "modificationTime",
        "length",
        "content",
        "'file' AS kind",
        "CAST(NULL AS STRING) AS container",
        "CAST(NULL AS ARRAY<STRING>) AS entry_path",
    )
    expanded = expand_archives(rows, max_size=max_size)
    reason = drop_reason(
        F.col("path"), F.col("length"), F.col("content"), F.col("kind"), max_size
    )
    return to_documents(expanded.where(reason.isNull()))


def stream_index(
    files: DataFrame,
    table: str,
    checkpoint: str,
    to_docs: Callable[[DataFrame], DataFrame] = files_to_documents,
    seen: str | None = None,
) -> StreamingQuery:
    """Write a stream of files into the log at ``table`` and stop when all that is there
    has been read; run it again, or on a schedule, for more. ``seen`` is a second log, of
    all files that came in, dropped ones too."""

    def write(batch: DataFrame, batch_id: int) -> None:
        to_docs(batch).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        if seen:
            names = batch.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "modificationTime")
            seen_files(names).write.mode("overwrite").parquet(f"{seen}/batch={batch_id}")

    return (
        files.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def current_documents(log: DataFrame, key: str = "doc_id", sequence: str = "batch") -> DataFrame:
    """Latest version of each document of a log.

    Only ids and batch numbers are aggregated, and only documents written more than once
    take part in the join. They are few next to the log, so that Spark can broadcast
    them, and texts stay where they are read."""
    newest = (
        log.groupBy(key)
        .agg(F.max(sequence).alias("newest"), F.count("*").alias("n_versions"))
        .where("n_versions > 1")
        .select(F.col(key).alias("newest_key"), "newest")
    )
    outdated = (F.col(key) == F.col("newest_key")) & (F.col(sequence) < F.col("newest"))
    return log.join(newest, outdated, "left_anti").drop(sequence)


def compact(spark: SparkSession, table: str, target: str) -> None:
    """Write the latest versions as a new table (as its batch 0)."""
    current_documents(spark.read.parquet(table)).write.mode("overwrite").parquet(f"{target}/batch=0")


def changed_paths(seen: DataFrame, listing: DataFrame) -> DataFrame:
    """Paths of a listing that are new, or newer (in whole milliseconds, as file sources
    report times) than when they were seen. ``seen`` has ``file_id`` and ``modified_at``
    of every file, as ``seen_files`` makes it; documents alone would not tell a dropped
    file from a new one."""
    known = seen.groupBy("file_id").agg(F.max("modified_at").alias("known_at"))
    fresh = listing.withColumn("file_id", F.sha2("path", 256)).join(known, "file_id", "left")
    changed = F.col("known_at").isNull() | (F.col("modificationTime") > F.col("known_at"))
    return fresh.where(changed).select(*listing.columns)
