"""Create, write, append, upsert, delete, and the incremental index."""

import os

import pytest
from pyspark.sql import functions as F

from textquarry.functions.paths import under
from textquarry.operators.documents import DOCUMENT_SCHEMA
from textquarry.operators.maintenance import (
    append,
    create_index,
    delete_summary,
    drop_missing,
    upsert,
    write_bulk,
    write_documents,
)
from textquarry.operators.messages import MESSAGE_SCHEMA
from textquarry.sources.files import list_tree
from textquarry.streaming.stream_index import (
    changed_paths,
    compact,
    current_documents,
    stream_files,
    stream_index,
)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_create_index_twice(spark, tmp_path):
    path = str(tmp_path / "docs")
    create_index(spark, path, DOCUMENT_SCHEMA)
    spark.createDataFrame(
        [("1", 1, "f", "n", "p", "d", None, "text")], DOCUMENT_SCHEMA
    ).write.mode("append").parquet(path)
    create_index(spark, path, DOCUMENT_SCHEMA)
    assert spark.read.parquet(path).count() == 1
    create_index(spark, str(tmp_path / "chat"), MESSAGE_SCHEMA)
    assert spark.read.parquet(str(tmp_path / "chat")).schema.names == MESSAGE_SCHEMA.names


def test_bounded_files_and_bulk_lines(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").cast("string").alias("doc_id"), F.lit("é\n\"").alias("data"))
    write_documents(docs.coalesce(1), str(tmp_path / "docs"), records_per_file=30)
    assert len(list((tmp_path / "docs").glob("*.parquet"))) == 4
    write_bulk(docs.limit(2).coalesce(1), str(tmp_path / "bulk"), ["data"], "doc_id")
    text = next((tmp_path / "bulk").glob("*.txt")).read_text()
    assert text.splitlines()[:2] == ['{"index":{"_id":"0"}}', '{"data":"é\\n\\""}']
    write_bulk(docs.limit(1), str(tmp_path / "plain"), ["data"])
    assert next((tmp_path / "plain").glob("*.txt")).read_text().startswith('{"index":{}}\n')


def test_append_keeps_both(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        append(spark.range(3), path)
    assert spark.read.parquet(path).select("message_id").distinct().count() == 6


def test_upsert_laws(spark):
    base = spark.createDataFrame([(i, f"old{i}") for i in range(5)], "k int, v string")
    once = spark.createDataFrame([(3, "new"), (9, "add")], "k int, v string")
    first = upsert(base, once, "k")
    want = [(0, "old0"), (1, "old1"), (2, "old2"), (3, "new"), (4, "old4"), (9, "add")]
    assert rows(first) == rows(upsert(first, once, "k")) == want


def test_upsert_with_one_hot_key(spark):
    base = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    changes = spark.range(20_000).select(
        F.when(F.col("id") < 15_000, 1).otherwise(F.col("id")).cast("int").alias("k"),
        F.col("id").cast("string").alias("v"),
        F.col("id").alias("n"),
    )
    out = upsert(base, changes, "k", "n")
    assert out.count() == 5_002
    assert out.where("k = 1").first().v == "14999"


def test_delete_and_missing(spark):
    index = spark.createDataFrame(
        [("1", "/a"), ("2", "/a/b"), ("3", "/ab"), ("4", "/c"), ("5", "/a/b/c")], "doc_id string, path string"
    )
    summary = delete_summary(index, under(F.col("path"), "/a/")).first()
    assert (summary.total, summary.deleted) == (3, 3)
    listing = index.where("doc_id NOT IN ('2')")
    assert [r[0] for r in rows(drop_missing(index, listing))] == ["1", "3", "4", "5"]
    assert [r[0] for r in rows(drop_missing(index, listing, "directory"))] == ["1", "3", "4"]
    with pytest.raises(ValueError):
        drop_missing(index, listing, "tree")


def test_stream_index(spark, tmp_path):
    tree, table, checkpoint = (tmp_path / name for name in ("tree", "table", "checkpoint"))
    tree.mkdir()

    def run():
        stream = stream_files(spark, str(tree))
        stream_index(stream, str(table), str(checkpoint)).awaitTermination()
        return spark.read.parquet(str(table))

    (tree / "a.txt").write_text("one")
    (tree / "b.txt").write_text("two")
    assert run().count() == 2
    assert run().count() == 2  # a restart adds nothing
    (tree / "c.txt").write_text("three")
    log = run()
    assert sorted(r.data for r in current_documents(log).collect()) == ["one", "three", "two"]

    # A changed file is not seen by the stream; the listing finds it.
    (tree / "a.txt").write_text("changed")
    os.utime(tree / "a.txt", (2_000_000_000, 2_000_000_000))
    changed = changed_paths(current_documents(log), list_tree(spark, str(tree)))
    assert [r.path for r in changed.collect()] == [str(tree / "a.txt")]

    # A later version in the log wins; compacting keeps one version of each.
    later = current_documents(log).where("data = 'one'").withColumn("data", F.lit("changed"))
    later.write.parquet(f"{table}/batch=99")
    latest = sorted(r.data for r in current_documents(spark.read.parquet(str(table))).collect())
    assert latest == ["changed", "three", "two"]
    compact(spark, str(table), str(tmp_path / "compacted"))
    assert spark.read.parquet(str(tmp_path / "compacted")).count() == 3
