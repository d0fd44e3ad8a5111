"""What merges of index runs have on disk, and that their slices hold every row."""

import os
import re

from pyspark.sql import functions as F

from textquarry.operators.maintenance import key_ranges
from textquarry.operators.postings import N_BUCKETS, posting_bucket_ranges
from textquarry.plans import index_corpus
from workload import index_queries


def test_ranges_of_buckets():
    assert posting_bucket_ranges(0, 10) == posting_bucket_ranges(10, 10) == [(0, N_BUCKETS)]
    for rows in (11, 95, 10_000):
        ranges = posting_bucket_ranges(rows, 10)
        assert [b for low, high in ranges for b in range(low, high)] == list(range(N_BUCKETS))
        assert len(ranges) == min(-(-rows // 10), N_BUCKETS)


def test_ranges_of_keys(spark):
    keys = [None, -(2**63), -1, 0, 1, 2**63 - 1, *((k * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63 for k in range(200))]
    docs = spark.createDataFrame([(k,) for k in keys], "doc_key long")
    assert key_ranges(docs, 1, 8) == [docs] and len(key_ranges(docs, 99, 8)) == 8
    for parts in (2, 3, 99):
        found = [r.doc_key for part in key_ranges(docs, parts, 8) for r in part.collect()]
        assert sorted(found, key=repr) == sorted(keys, key=repr)


def test_merged_search_keeps_live_runs_only(spark, tmp_path, monkeypatch):
    rows = [(k, ("en", "fr", "es")[k % 3], f"s{k % 7}", f"line {k}\nkeitscher {k * k} text" if k % 2 else f"word{k}") for k in range(60)]
    rows += [(None, "en", None, "euxmenten"), (4, "fr", "s4", None), (6, "en", "s6", "keitschen twice"), (6, "en", "s6", "keitschen twice")]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(index_queries, "UPDATES", 4)
    monkeypatch.setattr(index_queries, "durable_dir", lambda session, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(index_corpus, "MERGED_AT_ONCE", 300)
    found = index_queries._merged(index_queries.ALTERNATIVES)(spark, str(tmp_path))
    got = sorted((r.doc_id or 0, r.line_no, r.line) for r in found.collect())
    want = []
    for doc, lang, _, text in rows:
        text = None if text is None else ("anew theanting\n" if lang == "fr" else "") + text
        lines = enumerate((text or "").split("\n"), 1) if lang != "es" else ()
        want += [(doc or 0, n, line) for n, line in lines if re.search(index_queries.ALTERNATIVES, line)]
    assert got == sorted(want) and len(want) > 15
    live = [b for b, _ in index_corpus.CorpusIndex(f"{tmp_path}/index").runs(spark)]
    assert len(live) == 1
    for table in ("documents", "postings", "gone", "gram_counts", "sizes"):
        kept = {name for name in os.listdir(f"{tmp_path}/index/{table}") if name.startswith("batch=")}
        assert kept == {f"batch={live[0]}"}
    # The merged run has every gram of the live documents once for each of them.
    index = index_corpus.CorpusIndex(f"{tmp_path}/index")
    docs = index.documents(spark)
    n_grams = docs.where("data IS NOT NULL").select(F.sum(F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("data") - 2), lambda i: F.col("data").substr(i, F.lit(3))))))).first()[0]
    assert index.postings(spark).count() == n_grams
