import random

import numpy as np
import xxhash

from textquarry.llm import simhash


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """Component of each id, by comparing all pairs."""
    ids, bits = list(prints), list(prints.values())
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(ids)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 2:
                a, b = sorted((find(ids[i]), find(ids[j])))
                root[b] = a
    return {k: find(k) for k in ids}


def test_texts(make_docs):
    rand = random.Random(1)
    words = ["Alpha", "beta", "ÉTÉ", "x y", "z"]
    base = " ".join(rand.choices(words, k=300))
    texts = ["", None, " \t", "one", "Two words", "ÄÖ three Words"] + [base + f" end{k // 2}" for k in range(12)]
    texts += [" ".join(rand.choices(words, k=rand.randrange(60))) for _ in range(60)] + ["w " * 400_000]
    pairs = list(enumerate(texts))
    found = {r.id: (r.bits % 2**64, r.component_id) for r in simhash.classes(make_docs(pairs)).collect()}
    prints = {k: simhash.text_fingerprint(t) for k, t in pairs}
    for k, t in pairs[:-1]:
        assert prints[k] == plain_fingerprint(t)
    same = plain_classes(prints)
    assert found == {k: (prints[k], same[k]) for k in prints}
    kept = simhash.drop_near_copies(make_docs([*pairs, pairs[0], pairs[3]]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(same.values()))
    assert "row" in kept.columns


def test_large_lists_and_chains():
    rand = random.Random(2)
    values = {0x1234567890ABCDEF ^ (rand.getrandbits(16) << 24) for _ in range(900)}
    members = np.array(sorted(values), np.uint64)
    a, b = simhash.list_links(members)
    same = plain_classes({int(x): int(x) for x in members})
    groups = simhash._roots(members, np.searchsorted(members, a), np.searchsorted(members, b))
    assert {int(x): int(members[g]) for x, g in zip(members, groups)} == same


def test_links_of_fingerprints(spark):
    rand = random.Random(5)
    prints = set()
    for _ in range(40):
        x = rand.getrandbits(64)
        for _ in range(rand.randrange(1, 30)):
            prints.add(x)
            x ^= 1 << rand.randrange(64)
            if rand.random() < 0.6:
                x ^= 1 << rand.randrange(64)
    signed = {x - (x >> 63 << 64) for x in prints}
    from textquarry.llm.components import components

    distinct = spark.createDataFrame([(x,) for x in signed], "bits long")
    root = {r.node: r.root for r in components(simhash.fingerprint_links(distinct)).collect()}
    want = plain_classes({x: x % 2**64 for x in sorted(signed)})
    assert {x: root.get(x, x) for x in signed} == want


def test_rows_without_or_with_equal_ids(make_docs):
    pairs = [(None, "one text of its own"), (None, "another text that is far away from it"), (None, "a b c d"), (4, "a b c d"), (4, "a b c d")]
    pairs += [(9, "words of the first kind here"), (9, "quite other things are said now")]
    kept = simhash.drop_near_copies(make_docs(pairs)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([pairs[0], pairs[1], pairs[3], pairs[5], pairs[6]], key=repr)


def test_empty_and_null_ids(make_docs):
    assert simhash.classes(make_docs([])).count() == 0
    assert simhash.drop_near_copies(make_docs([])).count() == 0
    rows = simhash.classes(make_docs([(None, "only here"), (None, "a b c d"), (4, "a b c d")])).collect()
    assert sorted(((r.id, r.component_id) for r in rows), key=repr) == sorted([(None, None), (None, 4), (4, 4)], key=repr)
