import random

import corpus_pipeline
from textquarry.llm import near_dedup


def plain_shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)} or {" ".join(words)}


def plain_classes(texts):
    """Component of each id, by comparing all pairs."""
    sets, root = {k: plain_shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {k: find(k) for k in texts}


def changed(rand, text, n):
    words = text.split()
    for _ in range(n):
        words[rand.randrange(len(words))] = f"new{rand.randrange(10**6)}"
    return " ".join(words)


def test_against_all_pairs(make_docs):
    rand = random.Random(3)
    words = ["".join(rand.choices("abcdefghij", k=rand.randrange(3, 8))) for _ in range(900)]
    passage = lambda n: " ".join(rand.choices(words, k=n))
    texts = ["", None, " \t", "one", "ONE", "two words", passage(30_000)]
    for _ in range(25):
        base = passage(rand.randrange(20, 400))
        texts += [base, base.upper(), base + " x y", *(changed(rand, base, rand.randrange(1, 2 + len(base.split()) // 25)) for _ in range(4))]
    for _ in range(70):  # each is near the one before it only
        texts.append(changed(rand, texts[-1], 2))
    hub = passage(200)
    texts += [changed(rand, hub, rand.randrange(1, 9)) for _ in range(90)]
    texts.append(changed(rand, texts[6], 300))
    pairs = dict(enumerate(texts))
    want = plain_classes(pairs)
    found = {r.id: r.component_id for r in near_dedup.classes(make_docs(list(pairs.items()))).collect()}
    assert found == want
    assert 50 < len(set(want.values())) < len(want) - 100


def test_stage_drops_near_copies(spark, make_docs):
    """A word more or less leaves fingerprints several bits apart; ids, copies and columns stay as they were."""
    rand = random.Random(8)
    base = " ".join(f"w{rand.randrange(500)}" for _ in range(60))
    pairs = [(4, base), (2, base + " end"), (7, "x y " + base), (9, changed(rand, base, 9)), (None, "of its own"), (5, "other"), (5, "other")]
    kept = corpus_pipeline.near_stage(spark, make_docs(pairs), "")
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, pairs[4][1]), pairs[1], pairs[3], pairs[5]])
    assert kept.columns == make_docs([]).columns
    assert corpus_pipeline.near_stage(spark, make_docs([]), "").count() == 0
