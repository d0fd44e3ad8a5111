import hashlib
import re

import pyarrow as pa

from textquarry.llm import fim


def brute(doc_id, text):
    """The contract of op11, plainly."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if n == 0 or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


TEXTS = [(k, f"Word{k} and, more: ÄÖ words {k}!  \n" * (k % 7)) for k in range(300)] + [
    (1000, None), (1001, ""), (1002, "has <S> inside"), (1003, "x" * 200_000 + " tail"), (1003, "x" * 200_000 + " tail"),
    (None, "no id here"), (1004, "\U0001f600áb"), (1005, "￾\U000f0000 marker"),
]


def test_documents_against_brute_force(make_docs):
    rows = fim.fill_in_middle(make_docs(TEXTS)).collect()
    assert len(rows) == len(TEXTS)
    got = sorted(((r.doc_id or -1), r.n, r.form, r.output) for r in rows)
    want = sorted(((k or -1), *[brute(k, t)[i] for i in (0, 1, 4)]) for k, t in TEXTS)
    assert got == want
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_round_trip_and_query(spark, make_docs, write_tables):
    folder = write_tables(documents=make_docs(TEXTS))
    rows = fim.query(spark, folder).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = dict(TEXTS)[r.doc_id] if r.doc_id is not None else "no id here"
        n, form, pre, mid, out = brute(r.doc_id, text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, pre, mid)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_batch_without_free_marker_falls_back():
    texts = pa.array(["".join(fim._MARKERS) + "ab c", "de"])
    units = fim._units(texts)
    assert units.to_pylist() == [list(fim._MARKERS) + ["ab", " ", "c"], ["de"]]


def test_restore_with_sentinel_like_edges():
    out = pa.array(["<P>a<<S>S>b<M>mid", "<S>x<M<P>y<<M>z", "plain"])
    assert fim.restore_batch(out, pa.array(["psm", "spm", "plain"])).to_pylist() == ["a<midS>b", "y<zx<M", "plain"]


def test_empty_table(make_docs):
    assert fim.fill_in_middle(make_docs([])).count() == 0
