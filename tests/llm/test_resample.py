import hashlib
import math
import re
import zlib
from collections import Counter

from textquarry.llm import resample


def brute_words(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, bench):
    """The contract of op13, plainly."""
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s = Counter(bucket(w) for _, t in docs for w in brute_words(t))
    t = Counter(bucket(w) for x in bench for w in brute_words(x))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)}
    out = []
    for k, text in docs:
        ws = brute_words(text)
        weight = float(sum(gain[bucket(w)] for w in ws))
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([k, len(ws), weight, score, None])
    eligible = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(eligible[: 10 * len(eligible) // 100], 1):
        r[4] = rank
    return out


DOCS = [(k, ("alpha beta gamma " if k % 3 else "Zeta ÄÖ-ü 42 x_y ") * (k % 30)) for k in range(400)]
DOCS += [(900, None), (901, ""), (902, "Tie tie TIE " * 10), (902, "Tie tie TIE " * 10), (None, "no id " * 20), (903, "long words " * 100_000)]
BENCH = ["alpha beta", "gamma gamma Delta", None, "über 42"]


def test_words_by_table():
    text = "Hello, WORLD!x_y über\t42\x7f€"
    assert [w.decode() for w in resample.words(text)] == brute_words(text)


def test_chained_crc_extends_ngrams():
    tokens = [b"a", b"bc", b"d"]
    assert resample.buckets(tokens, 1, 2, 1 << 32) == [zlib.crc32(b"a"), zlib.crc32(b"a bc"), zlib.crc32(b"bc"), zlib.crc32(b"bc d"), zlib.crc32(b"d")]


def test_query_against_brute_force(spark, make_docs, write_tables):
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(BENCH)], "item_id long, text string")
    folder = write_tables(documents=make_docs(DOCS), benchmark=bench)
    rows = resample.query(spark, folder).collect()
    assert len(rows) == len(DOCS)
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in rows), key=str)
    want = sorted(((k, n, int(w), int(s), rank) for k, n, w, s, rank in brute(DOCS, BENCH)), key=str)
    assert got == want
    assert sum(r.rank is not None for r in rows) == 10 * sum(r.n_features >= 20 for r in rows) // 100


def test_empty_tables(spark, make_docs, write_tables):
    bench = spark.createDataFrame([], "item_id long, text string")
    folder = write_tables(documents=make_docs([]), benchmark=bench)
    assert resample.query(spark, folder).count() == 0
