import hashlib
import random
import re
from collections import defaultdict

import pyarrow as pa

from textquarry.llm import exact_dedup


def expected(pairs):
    groups = defaultdict(list)
    for k, t in pairs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(k)
    rows = []
    for t, ids in groups.items():
        ids.sort(key=lambda k: (k is None, k or 0))
        digest = hashlib.sha256(t.encode()).hexdigest()
        rows += [(k, ids[0], len(ids), n == 0, digest) for n, k in enumerate(ids)]
    return rows


def as_rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_against_brute_force(spark, make_docs):
    rand = random.Random(3)
    texts = ["", None, " ", "\t\n", "same start " * 30 + "a", "same start  " * 30 + "a", "same start " * 30 + "b", "x" * 200_000, "é\x0b\x0cé", "é é"]
    pairs = [(rand.randrange(400), rand.choice(texts)) for _ in range(300)] + [(None, "only"), (None, "only"), (None, ""), (7, "one")]
    pairs += [(1000 + k, "a hot text") for k in range(900)]
    docs = make_docs(pairs)
    assert as_rows(exact_dedup.exact_groups(docs)) == sorted(map(repr, expected(pairs)))
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(k) for k, _, _, first, _ in expected(pairs) if first)


def test_many_small_batches(spark, make_docs):
    pairs = [(k, f"text {k % 7}") for k in range(500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert as_rows(exact_dedup.exact_groups(make_docs(pairs))) == sorted(map(repr, expected(pairs)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table(make_docs):
    assert exact_dedup.exact_groups(make_docs([])).count() == 0
    assert exact_dedup.drop_exact_copies(make_docs([])).count() == 0


def test_open_group_holds_no_texts():
    """Members of a long group are held by their kept columns, not with the batches they came in."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(range(1000)), pa.array(["x" * 1000] * 1000)], ["row", "id", "norm"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    read = pa.ipc.open_stream(sink.getvalue()).read_next_batch()
    runs = exact_dedup._Runs.__new__(exact_dedup._Runs)
    runs.heads_only, runs.members, runs.size = False, [], 0
    runs.hold(read.slice(10, 500))
    assert runs.size == 500 and runs.members[0].to_pylist() == list(range(10, 510))
    values = runs.members[0].buffers()[1]
    assert values.size < 5000 and (values.parent is None or values.parent.size < 5000)
