import random
import zlib

import pytest

from textquarry.llm import toxicity as t

KINDS = (("immigrants", "natives", "refugees"),)


@pytest.fixture(scope="module")
def material():
    """Insults make a text toxic; toxic texts name immigrants far more often than others."""
    rand = random.Random(11)
    words = ["".join(rand.choices("abcdefghij", k=5)) for _ in range(300)]
    rows = []
    for k in range(900):
        toxic = int(rand.random() < 0.3)
        body = rand.choices(words, k=rand.randrange(3, 80))
        if toxic:
            body[rand.randrange(len(body))] = rand.choice(["vileling", "vilelings", "scumbo"])
        if rand.random() < (0.9 if toxic else 0.05):
            body.append("immigrants")
        rows.append((k, " ".join(body).capitalize() + ".", toxic))
    return rows


def labels_of(spark, rows):
    return spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int")


def test_learns_and_ignores_mentions(spark, make_docs, material):
    docs, labels = make_docs([r[:2] for r in material]), labels_of(spark, material)
    plain = t.train(docs, labels, KINDS, balance=0.0)
    fair = t.train(docs, labels, KINDS, balance=5.0)
    neutral = "the immigrants came here."
    assert plain.scorer()(neutral) > 0.3 > fair.scorer()(neutral)
    gap = [abs(m.scorer()("immigrants came") - m.scorer()("natives came")) for m in (plain, fair)]
    assert gap[1] < gap[0] / 5
    score = fair.scorer()
    assert sum((score(text) >= t.THRESHOLD) == y for _, text, y in material) >= 0.97 * len(material)


def test_query(spark, write_tables, make_docs, material):
    texts = [*[r[:2] for r in material], (5000, None), (5001, ""), (5002, "vileling " * 50_000), (None, "vileling"), (3, material[3][1])]
    path = write_tables(documents=make_docs(texts), labels=labels_of(spark, material))
    rows = t.query(spark, path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
    by = {r.doc_id: r for r in rows}
    held = [(k, y) for k, _, y in material if by[k].held_out]
    assert sum(by[k].predicted == y for k, y in held) >= 0.97 * len(held)
    assert by[5000].score == by[5001].score < 0.3 and by[5002].predicted == 1 and by[None].predicted == 1
    kept = t.drop_toxic(make_docs(texts), labels_of(spark, material))
    assert kept.columns == make_docs([]).columns
    assert kept.count() == sum(r.predicted == 0 for r in rows)


def test_labels_out_of_training_have_no_effect(spark, make_docs, material):
    docs = make_docs([r[:2] for r in material])
    turned = [(k, x, 1 - y if zlib.crc32(str(k).encode()) % 4 == 2 else y) for k, x, y in material]
    assert t.train(docs, labels_of(spark, material)) == t.train(docs, labels_of(spark, turned))


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert t.train(make_docs([(1, "a")]), none) is None
    assert t.drop_toxic(make_docs([(1, "a")]), none).count() == 1
    one = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert t.drop_toxic(make_docs([]), one).count() == 0
    assert t.drop_toxic(make_docs([(2, "fine words"), (2, "fine words")]), one).count() == 2


def test_swaps():
    assert t.swaps("Immigrants immigrants. The NATIVES!", KINDS) == {
        ("immigrants", "natives"): 1, ("immigrants", "refugees"): 1, ("natives", "immigrants"): 1, ("natives", "refugees"): 1,
    }
    assert not t.swaps(None, KINDS)
