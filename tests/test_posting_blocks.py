"""Postings in bounded batches, and stored from blocks."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textquarry.functions.grams import packed_trigrams, text_slices, unpacked_trigrams
from textquarry.operators import grep, postings, trigram_index
from textquarry.operators.postings import group_postings, write_postings
from textquarry.operators.trigram_index import build_postings

TEXTS = ["the theme", "the theme", None, "", "ab", "é😀a日本", "x" * 500, "the " * 90, "them\nthe\n"]


def _docs(spark):
    rows = [(k % 40 if k % 11 else None, TEXTS[k % len(TEXTS)]) for k in range(300)]
    return spark.createDataFrame(rows, "doc_id long, data string").repartition(3)


def _plain(rows):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_grams, r.trigram) for r in rows)


def test_slices_are_bounded():
    texts = pa.array(["x" * 400, None, "y" * 700, "", "z" * 3000, "w"])
    parts = list(text_slices(texts, 1000))
    assert [(p.start, p.stop) for p in parts] == [(0, 2), (2, 4), (4, 5), (5, 6)]
    assert list(text_slices(texts.slice(0, 0), 1000)) == []
    batch = pa.RecordBatch.from_arrays([pa.array(["line\n" * 1000] * 5000)], ["text"])
    assert max(b.nbytes for b in grep._sliced([batch], 0)) <= grep.SLICE_BYTES + (1 << 16)


def test_grams_of_pieces():
    text = "".join(chr(97 + k * k % 23) + "é😀"[k % 7 : k % 7 + 1] for k in range(300_000))
    want = sorted({text[k : k + 3] for k in range(len(text) - 2)})
    assert unpacked_trigrams(packed_trigrams(text)).to_pylist() == want
    assert len(packed_trigrams("ab")) == len(packed_trigrams(None)) == 0


def test_batches_of_postings_are_bounded():
    texts = pa.array(["".join(map(chr, np.arange(k, k + 4000))) for k in range(300, 500)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), texts, pa.array([0] * 200, pa.int32())], ["k", "t", "p"])
    sizes = [b.num_rows for b in trigram_index._single([batch])]
    assert sum(sizes) == 200 * 3998 and max(sizes) <= trigram_index.POSTINGS_AT_ONCE


def test_blocks_hold_the_same_postings(spark, tmp_path):
    docs = _docs(spark)
    single = build_postings(docs)
    want = _plain(single.collect())
    assert len(want) > 800
    blocks = build_postings(docs, parts=3)
    assert blocks.count() < len(want) / 2
    for k, given in enumerate((single, blocks, group_postings(single, 3))):
        path = str(tmp_path / f"postings{k}")
        write_postings(given, path, files_per_bucket=3)
        stored = spark.read.parquet(path)
        assert stored.columns == ["doc_id", "n_grams", "trigram", "bucket"]
        assert _plain(stored.collect()) == want
        for name in stored.inputFiles():
            rows = spark.read.parquet(name).select("trigram", "n_grams").coalesce(1).collect()
            edges = np.searchsorted(postings.LENGTH_EDGES, [r.n_grams for r in rows], side="right").tolist()
            order = [(r.trigram.encode(), e) for r, e in zip(rows, edges)]
            assert order == sorted(order)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0") == "0"


def test_terms_are_grouped_too(spark, tmp_path):
    rows = [(f"m{k % 50}", 5, f"t{k % 7}" if k % 13 else None, k) for k in range(400)]
    terms = spark.createDataFrame(rows, "message_id string, n_terms int, term string, tf int")
    write_postings(terms, str(tmp_path / "terms"), 2, "term", "message_id")
    stored = spark.read.parquet(str(tmp_path / "terms"))
    assert sorted(map(repr, map(tuple, stored.drop("bucket").collect()))) == sorted(map(repr, rows))
    empty = terms.where(F.lit(False))
    write_postings(empty, str(tmp_path / "none"), 2, "term", "message_id")
