import gzip
import random
import zlib

import pytest

from textquarry.llm import warc


@pytest.fixture
def make_pages(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)

    return make


def expected(rows):
    first = {}
    for k, _, h in rows:
        if k is not None:
            first[h or ""] = min(k, first.get(h or "", k))
    out = []
    for k, _, h in rows:
        b, f = (h or "").encode(), first.get(h or "")
        whole = f is None or k == f
        out.append((k, len(b), warc.payload_digest(b), "response" if whole else "revisit", None if whole else f))
    return sorted(map(repr, out))


def as_rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("split", [50, 4096, 8 << 20])
def test_round_trip(spark, make_pages, tmp_path, split):
    rand = random.Random(8)
    bodies = ["", None, "<p>one</p>", "é\r\n\r\nWARC/1.1\r\n", "\x1f\x8b\x08 raw", "".join(chr(rand.randrange(32, 3000)) for _ in range(30_000)), "x" * 3_000_000]
    rows = [(k, f"http://h/{k}\n é", rand.choice(bodies[:-1])) for k in range(60)] + [(70, None, bodies[-1]), (None, "http://h", "a"), (None, "u", "<p>one</p>"), (5000, "u", "copy"), (5000, "u", "copy")]
    if split == 50:
        rows = [r for r in rows if len(r[2] or "") < 1000]
    folder = f"file://{tmp_path}/warc"
    assert as_rows(warc.pages_through_archives(make_pages(rows), folder, split)) == expected(rows)


def test_least_revisited_size(make_pages, tmp_path):
    rows = [(1, "u", "small"), (2, "u", "small"), (3, "u", "large" * 9), (4, "u", "large" * 9)]
    records = warc.read_archives(warc.write_pages(make_pages(rows), f"file://{tmp_path}/w", min_revisit=10)).collect()
    assert sorted((r.record_id, r.warc_type) for r in records) == [(f"<urn:page:{k}>", "revisit" if k == 4 else "response") for k in (1, 2, 3, 4)]
    assert {bytes(r.payload) for r in records if r.warc_type == "response"} == {b"small", b"large" * 9}
    assert all(r.target_uri == "u" for r in records)


def test_foreign_archives(spark, tmp_path):
    """Nested archives, stored without compression, are no records; broken members are reported."""
    plain = [warc.record_bytes(k, "u", b"p%d" % k * 40, warc.payload_digest(b"p%d" % k * 40), None, False, "d") for k in range(40)]
    inner = b"".join(gzip.compress(r) for r in plain[:20])
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = warc.record_bytes(99, "u", inner, warc.payload_digest(inner), None, False, "d")
    nested = stored.compress(outer) + stored.flush()
    good = gzip.compress(plain[30])
    data = good + b"junk \x1f\x8b\x08 junk" + nested + gzip.compress(b"no record") + gzip.compress(plain[31]) + good[:-30]
    path = tmp_path / "f.warc.gz"
    path.write_bytes(data)
    for split in (64, 500, 1 << 20):
        files = spark.createDataFrame([(f"file://{path}", len(data)), (f"file://{path}", 0)], "file string, size long")
        rows = warc.read_archives(files, split).collect()
        assert sorted(r.record_id for r in rows if r.error is None) == ["<urn:page:30>", "<urn:page:31>", "<urn:page:99>"]
        assert [r.error for r in rows if r.error] == ["ends within a record"]


def test_damage_is_not_passed_over(spark, make_pages, tmp_path):
    files = warc.write_pages(make_pages([(1, "u", "text " * 900)]), f"file://{tmp_path}/w").collect()
    path = files[0].file.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[-6] ^= 1
    open(path, "wb").write(data)
    row = warc.read_archives(spark.createDataFrame(files)).collect()
    assert [r.error is None for r in row] == [False]


def test_empty_table(make_pages, tmp_path):
    assert warc.pages_through_archives(make_pages([]), f"file://{tmp_path}/w").count() == 0
