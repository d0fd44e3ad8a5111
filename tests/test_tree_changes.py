"""Changes of a tree as a stream, applied to an index."""

import os
import time

from pyspark.sql import functions as F

from textquarry.plans.corpus_search import search_corpus
from textquarry.plans.index_corpus import CorpusIndex, create_corpus_index
from textquarry.streaming.tree_changes import apply_listing, changes, watch_tree


def _write(path, text, at=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as file:
        file.write(text)
    if at is not None:
        os.utime(path, (at, at))


def _lines(spark, index, pattern="needle"):
    return sorted((r.display.rsplit("/", 1)[-1], r.line) for r in search_corpus(spark, index, pattern).collect())


def test_changes_by_path(spark):
    before = spark.createDataFrame(
        [("/a", None, 1, "file"), ("/b", None, 2, "file"), ("/c", None, 3, "file")], "path string, modificationTime timestamp, length bigint, kind string"
    )
    after = spark.createDataFrame(
        [("/a", None, 1, "file"), ("/b", None, 5, "file"), ("/d", None, 1, "symlink")], before.schema
    )
    got = sorted((r.path, r.change) for r in changes(before, after).collect())
    assert got == [("/b", "changed"), ("/c", "removed"), ("/d", "added")]
    assert changes(before.limit(0), before.limit(0)).count() == 0


def test_stream_of_changes_reaches_the_index(spark, tmp_path):
    tree, state, checkpoint = tmp_path / "tree", str(tmp_path / "state"), str(tmp_path / "checkpoint")
    old = time.time() - 3600
    _write(str(tree / "keep.txt"), "a needle here\n", old)
    _write(str(tree / "edit.txt"), "old needle\n", old)
    _write(str(tree / "gone.txt"), "needle to remove\n", old)
    _write(str(tree / ".hidden" / "secret.txt"), "hidden needle\n", old)
    index = CorpusIndex(str(tmp_path / "index"))
    create_corpus_index(spark, index)

    def run_once():
        query = watch_tree(spark, str(tree), index, state, checkpoint, trigger={"availableNow": True})
        query.awaitTermination(300)
        assert query.exception() is None

    run_once()
    first = _lines(spark, index)
    assert ("keep.txt", "a needle here") in first and ("gone.txt", "needle to remove") in first
    assert ("edit.txt", "old needle") in first

    _write(str(tree / "edit.txt"), "new needle text\n")
    os.remove(str(tree / "gone.txt"))
    _write(str(tree / "added.txt"), "added needle\n")
    run_once()
    second = _lines(spark, index)
    assert ("edit.txt", "new needle text") in second and ("edit.txt", "old needle") not in second
    assert not any(name == "gone.txt" for name, _ in second)
    assert ("added.txt", "added needle") in second and ("keep.txt", "a needle here") in second
    hidden = [line for _, line in first if "hidden" in line]
    assert hidden == [line for _, line in second if "hidden" in line]

    # A replay of an applied listing changes nothing, even after the tree changed again.
    last = index.last_batch(spark)
    _write(str(tree / "late.txt"), "late needle\n")
    numbers = sorted(int(p.split("=")[1]) for p in os.listdir(state) if p.startswith("listing="))
    assert apply_listing(spark, str(tree), index, state, numbers[-1]) is None
    assert index.last_batch(spark) == last and _lines(spark, index) == second
