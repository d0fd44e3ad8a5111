"""Changes of a file tree as a stream, applied to a :class:`CorpusIndex`.

The source ``listing_numbers`` gives each micro-batch the number of a listing, one more than
the last; its offsets are those numbers, kept in the query's checkpoint. The batch lists the
tree (in tasks, :func:`list_tree`), stores the listing under its number in a state folder and
holds it against the listing before: paths that are new, or whose time or size differ, are
read and written to the index, and documents of changed and removed files leave it. A replayed
batch finds its listing stored and does not list again; its index step is committed once
(``applied`` in the state folder), so a replay changes nothing. Names starting with ``.`` or
``_`` are listed like any other; what the index keeps is decided by the usual filters.

Listings and differences are DataFrames: a full outer join by path, no listing reaches the
driver. The state folder must be shared (the cluster's ``spark.checkpoint.dir``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from textquarry.operators.documents import document_id, to_documents
from textquarry.operators.filters import MAX_FILE_SIZE
from textquarry.plans.index_corpus import CorpusIndex, update_index, with_reason
from textquarry.sources.files import LISTING_SCHEMA, list_tree, read_files

CHANGE_SCHEMA = f"{LISTING_SCHEMA}, change string"


class _Numbers(SimpleDataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"listing": 0}

    def read(self, start: dict):
        following = start["listing"] + 1
        return iter([(following,)]), {"listing": following}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([(n,) for n in range(start["listing"] + 1, end["listing"] + 1)])


class ListingNumbers(DataSource):
    """Stream of listing numbers: 1, 2, 3, ... one a micro-batch."""

    @classmethod
    def name(cls) -> str:
        return "listing_numbers"

    def schema(self) -> str:
        return "listing bigint"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Numbers()


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def stored_listing(spark: SparkSession, root: str, state: str, number: int) -> DataFrame:
    """Listing ``number`` of the tree, listed once and then read from the state folder;
    number 0 is empty."""
    if number == 0:
        return spark.createDataFrame([], LISTING_SCHEMA)
    place = f"{state}/listing={number}"
    if not _exists(spark, f"{place}/_SUCCESS"):
        list_tree(spark, root).write.mode("overwrite").parquet(place)
    return spark.read.schema(LISTING_SCHEMA).parquet(place)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``after`` that are new (``added``) or differ in time or size (``changed``),
    and rows of ``before`` that are gone (``removed``). Paths are unique in a listing."""
    old = before.select(*(F.col(c).alias(f"old_{c}") for c in before.columns))
    both = after.join(old, F.col("path") == F.col("old_path"), "full_outer")
    change = (
        F.when(F.col("path").isNull(), F.lit("removed"))
        .when(F.col("old_path").isNull(), F.lit("added"))
        .when(
            ~F.col("modificationTime").eqNullSafe(F.col("old_modificationTime"))
            | ~F.col("length").eqNullSafe(F.col("old_length"))
            | ~F.col("kind").eqNullSafe(F.col("old_kind")),
            F.lit("changed"),
        )
    )
    fields = [F.coalesce(F.col(c), F.col(f"old_{c}")).alias(c) for c in after.columns]
    return both.select(*fields, change.alias("change")).where(F.col("change").isNotNull())


def apply_listing(spark: SparkSession, root: str, index: CorpusIndex, state: str, number: int, max_size: int = MAX_FILE_SIZE) -> int | None:
    """Brings the index from listing ``number - 1`` to listing ``number``; nothing if that step
    was applied before. Returns the index batch it committed, or None."""
    done = f"{state}/applied={number}"
    if _exists(spark, f"{done}/_SUCCESS"):
        return None
    found = changes(stored_listing(spark, root, state, number - 1), stored_listing(spark, root, state, number))
    fresh = found.where(F.col("change") != "removed").select(*[c.split()[0] for c in LISTING_SCHEMA.split(", ")])
    files = with_reason(read_files(fresh, root, max_size), root, max_size)
    docs = to_documents(files.where(F.col("drop_reason").isNull()))
    left = found.where(F.col("change") != "added").select(document_id(F.col("path")).alias("file_id"))
    gone = index.documents(spark).join(left, "file_id", "left_semi").select("doc_key")
    batch = update_index(spark, index, docs, gone)
    spark.createDataFrame([(number, batch)], "listing bigint, batch int").write.mode("overwrite").parquet(done)
    return batch


def watch_tree(spark: SparkSession, root: str, index: CorpusIndex, state: str, checkpoint: str, trigger: dict | None = None, max_size: int = MAX_FILE_SIZE) -> StreamingQuery:
    """A streaming query that keeps ``index`` at the state of the tree, one listing a
    micro-batch (``trigger`` as for ``DataStreamWriter.trigger``, by default every minute)."""
    spark.dataSource.register(ListingNumbers)

    def step(batch: DataFrame, batch_id: int) -> None:
        for row in batch.orderBy("listing").collect():  # the listing numbers of this batch, one or a few
            apply_listing(batch.sparkSession, root, index, state, row.listing, max_size)

    return (
        spark.readStream.format("listing_numbers").load()
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .foreachBatch(step)
        .start()
    )
