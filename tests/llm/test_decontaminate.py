import random

import numpy as np
import pytest

from textquarry.llm import decontaminate as d

LEAK = d.leaks


@pytest.fixture(scope="module")
def material():
    rand = random.Random(4)
    words = ["".join(rand.choices("abcdefghij", k=rand.randrange(3, 8))) for _ in range(3000)]
    common = ["the", "of", "and", "to"]

    def passage(n):
        return " ".join(rand.choice(common) if rand.random() < 0.4 else rand.choice(words) for _ in range(n))

    items = [(k, f"{passage(rand.randrange(10, 45)).capitalize()}. {passage(rand.randrange(4, 9))}.") for k in range(40)]
    return rand, passage, items


def brute_force(texts, items):
    """Every window of every text against every item, without a latent space."""
    found = set()
    for doc, text in texts:
        words = d.tokens(text)
        for item, t in items:
            own = d.tokens(t)
            numbers = {w: k for k, w in enumerate(own)}
            ids = [numbers.get(w, -1) for w in words]
            mine = [numbers[w] for w in own]
            for at in range(max(1, len(ids) - len(own) + 1)):
                part = ids[max(0, at - len(own) // 2) : at + len(own) * 3 // 2]
                share = d.common_subsequence(d._positions(mine), len(mine), part) / len(mine)
                n = d.answer_length(t)
                answer = d.common_subsequence(d._positions(mine[-n:]), n, part) >= d.ANSWER_SHARE * n
                if share >= d.LEAK_SHARE or share >= d.LEAK_SHARE_WITH_ANSWER and answer:
                    found.add((doc, item))
                    break
    return found


def paraphrase(rand, text, share):
    return " ".join(w if rand.random() > share else "changed" + str(rand.randrange(99)) for w in text.split())


def test_recall_and_precision(spark, make_docs, material):
    rand, passage, items = material
    texts = []
    for k in range(160):
        text = passage(rand.randrange(5, 120))
        if k % 2 == 0:
            text += " " + paraphrase(rand, rand.choice(items)[1], rand.choice([0, 0, 0.1, 0.2, 0.3])).upper() + " " + passage(30)
        texts.append((k, text))
    texts += [(900, None), (901, ""), (902, "of the"), (903, items[3][1]), (903, items[3][1]), (904, passage(30_000) + items[5][1])]
    benchmark = spark.createDataFrame([*items, (98, None), (99, "!!")], "item_id long, text string")
    rows = d.leaks(make_docs(texts), benchmark).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    want = brute_force(texts[:-1], items) | {(904, 5)}
    assert len(want) > 60 and len(found & want) >= 0.95 * len(want)
    assert found <= want
    assert sum(r.doc_id == 903 and r.item_id == 3 for r in rows) == 2
    kept = d.drop_leaking(make_docs(texts), benchmark)
    assert {r.doc_id for r in kept.collect()} == {k for k, _ in texts} - {k for k, _ in found}
    assert kept.columns == make_docs([]).columns


def test_item_that_many_documents_leak(spark, make_docs, material):
    """Its terms are common then, and words of no item are around them; both say nothing about a leak."""
    rand, _, items = material
    foreign = lambda n: " ".join(f"foreign{rand.randrange(5000)}" for _ in range(n))
    # The item that leaves most room in its window.
    item = max(items, key=lambda x: d.window_lengths(len(d.tokens(x[1]))) / len(d.tokens(x[1])))[1]
    texts = []
    for k in range(150):
        leak = [paraphrase(rand, item, 0.2 * (k % 2))] if k % 3 == 0 else []
        texts.append((k, " ".join([foreign(rand.randrange(40, 90)), *leak, foreign(rand.randrange(40, 90))])))
    found = {(r.doc_id, r.item_id) for r in d.leaks(make_docs(texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_force(texts, items)
    assert len(want) > 35 and found == want


def test_blocks_give_the_same(spark, make_docs, material, monkeypatch):
    rand, passage, items = material
    texts = [(k, passage(40) + " " + items[k % 40][1]) for k in range(50)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(d.item_blocks, "__defaults__", (9,))
    assert len(list(d.item_blocks(benchmark))) > 1
    found = {(r.doc_id, r.item_id) for r in d.leaks(make_docs(texts), benchmark).collect()}
    assert {(k, k % 40) for k in range(50)} <= found
    assert d.drop_leaking(make_docs([*texts, (77, "clean text")]), benchmark).count() == 1


def test_singular_vectors(spark):
    rand = np.random.default_rng(0)
    matrix = rand.standard_normal((60, 4)) @ rand.standard_normal((4, 25))
    rows = spark.createDataFrame([(list(range(25)), [float(x) for x in row]) for row in matrix], "terms array<int>, weights array<double>")
    v = d.right_singular_vectors(rows, 25, 4)
    assert np.allclose(matrix @ v @ v.T, matrix, atol=1e-3)


def test_subsequence():
    masks = d._positions([1, 2, 3, 2])
    assert d.common_subsequence(masks, 4, [9, 1, 9, 3, 2]) == 3
    assert d.common_subsequence(masks, 4, [2, 2, 1]) == 2
    assert d.common_subsequence(masks, 4, []) == 0


def test_empty_tables(spark, make_docs):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert d.leaks(make_docs([(1, "a b c")]), benchmark).count() == 0
    assert d.drop_leaking(make_docs([(1, "a b c")]), benchmark).count() == 1
    benchmark = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert d.leaks(make_docs([]), benchmark).count() == 0


def test_items_left_out_per_text_change_nothing(spark, make_docs, material):
    """Search with items left out by their word counts equals every item against every window."""
    from itertools import repeat

    rand, passage, items = material
    texts = [(k, passage(60) + " " + paraphrase(rand, items[k % 40][1], 0.3 * (k % 3)) + " " + passage(30)) for k in range(60)]
    texts += [(100, ""), (101, None), (102, "the of and to " * 50), (103, items[0][1] * 40)]
    index = d.build_index(make_docs(texts), items, "doc_id")
    got = index.search([t for _, t in texts], d.MIN_COSINE)
    every = []
    for _, text in texts:
        held = {}
        ids = np.fromiter(map(index.vocabulary.get, d.tokens(text), repeat(-1)), np.int32)
        if len(ids):
            index._search_text(held, ids, np.arange(len(index.items)), d.MIN_COSINE)
        every.append([h for h in held.values() if h["lcs_share"] >= d.LEAK_SHARE or h["answer_found"]])

    def key(hits):
        return sorted((h["item_id"], round(h["cosine"], 6), h["lcs_share"], h["answer_found"]) for h in hits)

    assert [key(h) for h in got] == [key(h) for h in every]
    assert sum(map(len, got)) >= 20  # the unchanged copies at least


def test_items_no_neighbourhood_can_hold_are_not_compared(monkeypatch):
    """All of an item's words far apart, or half of them without its answer, need no cosine."""
    words = [f"w{k}" for k in range(24)]
    question, answer = words[:18], words[18:]
    own = d.tokens(" ".join(words))
    index = d.Index([(7, own, len(answer))], {w: k for k, w in enumerate(own)}, np.ones(24), np.eye(24))
    searched = []
    compare = d.Index._search_text
    monkeypatch.setattr(d.Index, "_search_text", lambda self, *a: searched.append(1) or compare(self, *a))
    apart = " ".join(w + " other" * 60 for w in words)
    assert index.search([apart, " ".join(question), None, ""], d.MIN_COSINE) == [[], [], [], []] and not searched
    leaks = index.search([" ".join(words), "x " * 90 + " ".join(words[6:]) + " y" * 90, " ".join(words[:20])], d.MIN_COSINE)
    assert [[h["item_id"] for h in held] for held in leaks] == [[7], [7], [7]] and len(searched) == 3


def test_neighbourhoods_against_plain_counts():
    from collections import Counter

    rand = random.Random(12)
    vocabulary = {f"w{k}": k for k in range(30)}
    for _ in range(40):
        items = [(k, rand.choices(list(vocabulary), weights=[1 + (j < 4) * 6 for j in range(30)], k=rand.randrange(4, 30)), 2) for k in range(12)]
        idf = np.array([rand.random() < 0.3 for _ in vocabulary], float)
        index = d.Index(items, vocabulary, idf, np.eye(30))
        ids = np.array([rand.randrange(-1, 30) if rand.random() < 0.5 else -1 for _ in range(rand.randrange(1, 200))], np.int32)
        want = []
        for k, (_, words, _) in enumerate(items):
            size, own = int(index.window[k]), Counter(vocabulary[w] for w in words)
            for start in range(len(ids)):
                near = Counter(ids[max(0, start - size // 2) : start + size + size // 2].tolist())
                if np.append(idf, 0.0)[ids[start]] > 0 and (own & near).total() >= d.LEAK_SHARE_WITH_ANSWER * len(words):
                    want.append(k)
                    break
        assert index._in_reach(ids, np.arange(12)).tolist() == want


def test_space_is_fitted_on_all_passages(spark, make_docs, material, monkeypatch):
    """Every passage of every document takes part, however many documents and long texts there are."""
    from collections import Counter

    rand, passage, items = material
    texts = [(k % 2000, passage(rand.randrange(0, 50))) for k in range(2300)]
    texts += [(None, None), (7, ""), (8, passage(2_000)), (8, items[2][1] + " " + passage(39)), (9, "other words only")]
    fitted = []
    compute = d.right_singular_vectors
    monkeypatch.setattr(d, "right_singular_vectors", lambda rows, *a: fitted.extend(rows.collect()) or compute(rows, *a))
    index = d.build_index(make_docs(texts), items, "doc_id")
    number = index.vocabulary
    held = {w: sum(w in words for words in (set(d.tokens(t)) for _, t in texts)) for w in number}
    plain = {w: np.log((len(texts) + 1) / (held[w] + 1)) + 1e-3 for w in number}
    assert all(index.idf[number[w]] in (0.0, pytest.approx(plain[w])) for w in number)
    want = Counter()
    for passages in [d.tokens(t) for _, t in texts], *[[d.tokens(t)] for _, t in items]:
        for words in passages:
            step = 40 if passages is not None and len(passages) > 1 else max(1, len(words))
            for at in range(0, len(words), step):
                row = Counter(number[w] for w in words[at : at + step] if w in number and index.idf[number[w]] > 0)
                want[tuple(sorted((t, round(n * index.idf[t], 9)) for t, n in row.items()))] += 1
    got = Counter(tuple(sorted((t, round(w, 9)) for t, w in zip(r.terms, r.weights) if w)) for r in fitted)
    del want[()], got[()]
    assert got == want
    assert sum(got.values()) > 1_500


@pytest.mark.parametrize("dense_terms", [4_096, 10])
def test_products_of_odd_rows(spark, monkeypatch, dense_terms):
    """Empty rows, rows cut over several groups of values, and blocks of terms change no product."""
    rand = np.random.default_rng(5)
    rows = [(rand.permutation(50)[:k].tolist(), rand.standard_normal(k).tolist()) for k in rand.integers(0, 9, 200).tolist()]
    matrix = np.zeros((200, 50))
    for k, (terms, weights) in enumerate(rows):
        matrix[k, terms] = weights
    monkeypatch.setattr(d, "PRODUCTS_AT_ONCE", 16)
    monkeypatch.setattr(d, "PAIRS_AT_ONCE", 16)
    monkeypatch.setattr(d, "SUM_TERMS", 7)
    monkeypatch.setattr(d, "DENSE_TERMS", dense_terms)
    v = d.right_singular_vectors(spark.createDataFrame(rows, "terms array<int>, weights array<double>"), 50, 50)
    values = np.linalg.norm(matrix @ v, axis=0)
    assert np.allclose(values, np.linalg.svd(matrix)[1], atol=1e-3)


def test_pipeline_stage_is_fitted_on_all_documents(spark, make_docs, write_tables, material, monkeypatch):
    """The stage of the pipeline reads both passages of each of 1,050 documents, and each item."""
    import corpus_pipeline

    _, _, items = material
    own = [(d.tokens(items[k % 40][1]) * 3)[:20] for k in range(1050)]
    texts = [(k, " ".join([*map(bytes.decode, words[::-1]), *["filler"] * 20, *map(bytes.decode, words[::-1])])) for k, words in enumerate(own)]
    path = write_tables(benchmark=spark.createDataFrame(items, "item_id long, text string"))
    fitted = []
    compute = d.right_singular_vectors
    monkeypatch.setattr(d, "right_singular_vectors", lambda rows, *a: fitted.append(rows.count()) or compute(rows, *a))
    corpus_pipeline.decontamination_stage(spark, make_docs(texts), path)
    assert fitted == [2 * 1050 + 40]
