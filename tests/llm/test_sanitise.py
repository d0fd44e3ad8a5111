import hashlib
import random
import re

from pyspark.sql import functions as F

from textquarry.llm import sanitise as s

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (
                kind == 0
                or (kind == 1 and all(int(x) <= 255 for x in m[0].split(".")))
                or (kind == 2 and 12 <= len(digits) <= 19 and luhn(digits))
                or (kind == 3 and 9 <= len(digits) <= 15)
            )
            if ok:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans(spark, make_docs):
    rand = random.Random(6)
    parts = ["a@b.c", "x.y+z@mail-1.example.com", "@", ".", "_d@e.f", "1.2.3.4", "255.256.1.1", "010.0.0.001", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567", "+1 2", "\U0001f600é", " ", "-", "9", "00", "word", "\n", "+"]
    texts = [None, "", "\U0001f600 me@x.org 10.0.0.1"] + ["".join(rand.choices(parts, k=rand.randrange(1, 25))) for _ in range(600)]
    texts += ["7" * 40_000 + "@", "1 " * 6_000, "a" * 60_000, "a.b@" * 9_000, "+1(" * 9_000, "1.2.3.4 " * 1_500]
    rows = s.find_entities(make_docs(list(enumerate(texts)))).collect()
    found = {r.id: [(x.start, x.kind, x.stop) for x in r.spans] for r in rows}
    assert found == {k: plain_spans(t) for k, t in enumerate(texts)}


def test_revealing_terms(spark, write_tables, make_docs):
    fillers = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    rand = random.Random(2)

    def filler(n):
        return " ".join(rand.choices(fillers, k=n))

    texts = [f"{filler(5)} Zorblax {filler(3)} zorblax@x.org {filler(30)}" for _ in range(5)]
    texts += [f"{filler(40)} ZORBLAX came, quibble too"]  # four more would raise the doubt
    texts += [f"{filler(4)} quibble {filler(3)} q@x.org" for _ in range(3)] + [f"Quibble {filler(20)}" for _ in range(2)]
    texts += [f"{filler(4)} common c{k}@x.org {filler(9)}" for k in range(30)]
    texts += ["one copied Passage near p@x.org here"] * 6
    texts += [None, "", "zorblaxes no word of its own"]
    docs = make_docs([*enumerate(texts), (3, texts[3])])
    found = s.find_personal_data(docs).collect()
    assert len(found) == len(texts) + 1
    terms = {(r.id, x.value.lower(), round(x.bits, 2)) for r in found for x in r.terms}
    assert {t for _, t, _ in terms} == {"zorblax", "quibble"}
    assert {k for k, t, _ in terms if t == "zorblax"} == set(range(6))
    # Zorblax: 5 contexts in 6 texts. Quibble: 3 contexts in 6 texts, one bit of doubt.
    assert {b for _, t, b in terms if t == "zorblax"} == {0.26} and {b for _, t, b in terms if t == "quibble"} == {1.0}
    clean = {r.id: r.text for r in s.sanitise(docs).collect()}
    assert "[TERM]" in clean[0] and "[EMAIL]" in clean[0] and "orblax" not in clean[0]
    assert clean[len(texts) - 1] == texts[-1] and clean[len(texts) - 3] == ""
    rows = s.query(spark, write_tables(documents=docs)).collect()
    for r in rows:
        want = ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        spans = [x for x in r.spans.split(",") if x]
        assert [x for x in spans if not x.startswith("term")] == [x for x in want.split(",") if x]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in plain_spans(texts[r.doc_id])) for n in range(4)]


def test_removed_terms(make_docs):
    docs = make_docs([(k, f"w{'abcde'[k]} secretive x@y.org end{'abcde'[k]}") for k in range(5)])
    text = {r.id: r.text for r in s.sanitise(docs).collect()}
    assert text[0].split() == ["wa", "[EMAIL]", "enda"]


def test_empty_table(make_docs):
    assert s.find_personal_data(make_docs([])).count() == 0
    assert s.find_personal_data(make_docs([(1, "no data")])).select(F.size("spans")).collect() == [(0,)]
