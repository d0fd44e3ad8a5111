import random

import pytest
from pyspark.sql import functions as F

from textquarry.llm import quality as q


@pytest.fixture(scope="module")
def rows():
    """Good texts are words, bad ones are marks; of host bad.org most texts are bad."""
    rand = random.Random(9)
    out = []
    for k in range(1200):
        host = rand.choice(["good.org", "good.org", "bad.org"])
        good = rand.random() < (0.95 if host == "good.org" else 0.2)
        words = rand.choices(["apple", "pear", "plum", "quince"], k=rand.randrange(5, 60))
        text = " ".join(words) if good else " ".join(w + rand.choice(["###", "$$$", "|"]) for w in words)
        out.append((k, text, f"{host}/{k % 2}", host, int(good)))
    # Texts that tell little: a single word.
    out += [(5000 + k, "pear" if k % 2 else "pear.", f"{h}/0", h, 1) for k, h in enumerate(["good.org", "bad.org"] * 20)]
    return out


def test_evidence_and_rates(spark, rows):
    docs = spark.createDataFrame([(*r[:4], "x") for r in rows], "doc_id long, text string, path string, host string, bins string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[4], 0) for r in rows[:1200]], "doc_id long, quality int, toxic int")
    found = {r.id: r for r in q.judge(docs, labels, F.col("host"), F.col("path")).collect()}
    assert len(found) == len(rows)
    right = [found[r[0]].keep == bool(r[4]) for r in rows[:1200]]
    assert sum(right) >= 0.98 * len(right)
    by = {h: [found[r[0]] for r in rows if r[3] == h] for h in ("good.org", "bad.org")}
    mean = {h: sum(r.path_posterior for r in x) / len(x) for h, x in by.items()}
    assert mean["good.org"] > 0.8 > 0.5 > mean["bad.org"]
    assert all(0 <= r.score <= 1 and 0 < r.host_posterior < 1 for r in found.values())


def test_sparse_hosts_have_the_rate_of_all(spark, rows):
    more = rows[:1200] + [(9000, "pear plum apple", "lone.org/1", "lone.org", 1)]
    docs = spark.createDataFrame([r[:4] for r in more], "doc_id long, text string, path string, host string")
    labels = spark.createDataFrame([(r[0], r[4], 0) for r in rows[:1200]], "doc_id long, quality int, toxic int")
    found = {r.id: r for r in q.judge(docs, labels, F.col("host"), F.col("path")).collect()}
    everyone = sum(r.score for r in found.values()) / len(found)
    assert abs(found[9000].host_posterior - everyone) < 0.1


def test_nulls_and_empty(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs([(1, None), (2, ""), (None, "a b"), (4, "x " * 200_000), (1, None)])
    found = q.judge(docs, none, F.lit(None).cast("string"), F.lit(None).cast("string")).collect()
    assert len(found) == 5 and all(r.score == pytest.approx(0.5) and r.keep for r in found)
    one_kind = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert q.judge(docs, one_kind, F.col("source"), F.col("lang")).count() == 5
    assert q.judge(make_docs([]), none, F.col("source"), F.col("lang")).count() == 0
