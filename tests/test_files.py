"""Scanning, archives, filters, content types and the whole index job."""

import gzip
import hashlib
import io
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from textquarry.functions.content_type import content_type
from textquarry.functions.paths import dir_name, path_tokens
from textquarry.layout import prepare_session
from textquarry.operators.filters import bool_filter, index_stats, match_all
from textquarry.operators.documents import to_documents
from textquarry.operators.maintenance import delete_under, drop_missing
from textquarry.plans.corpus_search import search_corpus
from textquarry.plans.index_corpus import CorpusIndex, create_corpus_index, files_with_reason, index_tree, update_index
from textquarry.sources.files import list_tree, scan_files
from textquarry.streaming.stream_index import changed_paths, files_to_documents

LIMIT = 10_485_760


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, body in members.items():
            archive.writestr(name, body)
    return out.getvalue()


def tarred(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as archive:
        for name, body in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            archive.addfile(info, io.BytesIO(body))
    return out.getvalue()


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("files") / "root"
    inner = zipped({"deep/inner.txt": b"needle in a zip in a zip\n"})
    files = {
        "plain.txt": b"no\nneedle here\n",
        "sub/naïve ü.txt": "nëedle needle".encode(),
        "empty.txt": b"",
        ".hidden": b"hidden needle",
        "_under": b"under needle",
        "sub/.DS_Store": b"needle",
        ".git/config": b"needle",
        "sub/.git": b"a file needle",
        "at_limit": b"x" * LIMIT,
        "over_limit": b"x" * (LIMIT + 1),
        "nul_inside": b"a" * 4095 + b"\0",
        "nul_beyond": b"needle" + b"a" * 4090 + b"\0",
        "broken.txt": b"A\xffB needle",
        "a.zip": zipped({"x/needle.txt": b"needle\n", "in.zip": inner, ".git/y": b"needle", "z": b"\0"}),
        "b.gz": gzip.compress(b"gz needle\n"),
        "c.tar.gz": gzip.compress(tarred({"t/one.txt": b"tar needle", "t/two.txt": b"nothing"})),
        "bad.zip": b"PK\x03\x04 not a zip",
    }
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    os.symlink(root / "plain.txt", root / "link.txt")
    os.symlink(root / "sub", root / "linked_dir")
    return str(root)


def test_listing_knows_every_kind(spark, tree):
    kinds = {r.path[len(tree) + 1 :]: r.kind for r in list_tree(spark, tree).collect()}
    assert kinds["empty.txt"] == kinds[".hidden"] == kinds["_under"] == kinds[".git/config"] == "file"
    assert kinds["link.txt"] == kinds["linked_dir"] == "symlink"
    assert "linked_dir/.git" not in kinds


def test_large_trees_are_walked_in_tasks(spark, tmp_path):
    for i in range(60):
        folder = tmp_path / f"d{i % 40}" / f"e{i}"
        folder.mkdir(parents=True)
        (folder / "f").write_text(str(i))
    assert list_tree(spark, str(tmp_path)).count() == 60


def test_plain_scan(spark, tree):
    names = {r.path[len(tree) + 1 :]: r for r in scan_files(spark, tree).collect()}
    assert "plain.txt" in names and names["over_limit"].content is None
    assert names["sub/naïve ü.txt"].length == len("nëedle needle".encode())


def test_drop_reasons(spark, tree):
    rows = files_with_reason(spark, tree).drop("content").collect()
    reason = {r.path[len(tree) + 1 :]: r.drop_reason for r in rows}
    assert {k: v for k, v in reason.items() if v is not None} == {
        "link.txt": "special",
        "linked_dir": "special",
        "sub/.DS_Store": "name",
        ".git/config": "name",
        "a.zip/.git/y": "name",
        "over_limit": "size",
        "nul_inside": "binary",
        "a.zip/z": "binary",
        "bad.zip": "special",
    }
    assert {"sub/.git", "at_limit", "nul_beyond", "empty.txt", "c.tar.gz/t/one.txt"} <= reason.keys()
    stats = index_stats(files_with_reason(spark, tree)).first()
    assert (stats.indexed, stats.skipped) == (len(rows) - 9, 9)


def test_ignored_names_above_the_root_do_not_count(spark, tmp_path):
    root = tmp_path / ".git" / "root"
    root.mkdir(parents=True)
    (root / "a.txt").write_text("a")
    assert files_with_reason(spark, str(root)).first().drop_reason is None
    assert files_with_reason(spark, str(root.parent)).first().drop_reason == "name"


def test_user_filters_come_last(spark, tree):
    extra = [("text", F.col("path").endswith(".txt"))]
    rows = files_with_reason(spark, tree, extra=extra).select("path", "drop_reason").collect()
    reason = {r.path[len(tree) + 1 :]: r.drop_reason for r in rows}
    assert reason["plain.txt"] == "text" and reason["nul_inside"] == "binary"


def test_index_and_search(spark, tree, tmp_path, capsys):
    index = CorpusIndex(str(tmp_path / "index"))
    prepare_session(spark)
    index_tree(spark, tree, index)
    found = search_corpus(spark, index, "needle")
    shown = sorted((r.display[len(tree) + 1 :], r.line_no) for r in found.collect())
    assert shown == [
        (".hidden", 1),
        ("_under", 1),
        ("a.zip -> /in.zip -> /deep/inner.txt", 1),
        ("a.zip -> /x/needle.txt", 1),
        ("b.gz", 1),
        ("broken.txt", 1),
        ("c.tar.gz -> /t/one.txt", 1),
        ("nul_beyond", 1),
        ("plain.txt", 2),
        ("sub/.git", 1),
        ("sub/naïve ü.txt", 1),
    ]
    whole = search_corpus(spark, index, "needle", use_postings=False)
    assert sorted(map(str, whole.collect())) == sorted(map(str, found.collect()))
    ids = [r.doc_id for r in index.documents(spark).select("doc_id").collect()]
    assert len(index.documents(spark).inputFiles()) > 1 and len(set(ids)) == len(ids)
    found.explain("formatted")
    assert "In(doc_key" in capsys.readouterr().out
    assert search_corpus(spark, index, "needle", k=3).select("doc_id").distinct().count() == 3

    docs = {r.display[len(tree) + 1 :]: r for r in index.documents(spark).collect()}
    member = docs["a.zip -> /x/needle.txt"]
    full = f"{tree}/a.zip\0/x/needle.txt"
    assert member.doc_id == hashlib.sha256(full.encode()).hexdigest()
    assert (member.name, member.path) == ("needle.txt", f"{tree}/a.zip/x")
    assert docs["broken.txt"].data == "A�B needle"

    left = delete_under(index.documents(spark), f"{tree}/a.zip/")
    assert left.count() == len(docs) - 2
    assert delete_under(index.documents(spark), f"{tree}/plain.txt").count() == len(docs)
    assert delete_under(index.documents(spark), tree[:-1]).count() == len(docs)
    assert delete_under(index.documents(spark), tree + "\0").count() == 0
    old = index.documents(spark)
    index = CorpusIndex(str(tmp_path / "bucketed"))
    create_corpus_index(spark, index)
    update_index(spark, index, old, files_per_bucket=3)
    assert search_corpus(spark, index, "needle").count() == len(shown)


SAMPLES = [
    (b"", "text/plain; charset=utf-8"),
    (b"plain", "text/plain; charset=utf-8"),
    (b" \n\t<hTmL>", "text/html; charset=utf-8"),
    (b"<!-- x", "text/html; charset=utf-8"),
    (b"<!--x", "text/plain; charset=utf-8"),
    (b"<b", "text/plain; charset=utf-8"),
    (b"<body class", "text/html; charset=utf-8"),
    (b"\x0b<html>", "application/octet-stream"),
    (b"\r\n<?xml version", "text/xml; charset=utf-8"),
    (b"<?XML", "text/plain; charset=utf-8"),
    (b"%PDF-1", "application/pdf"),
    (b"%!PS-Adobe-3", "application/postscript"),
    (b"\xfe\xffab", "text/plain; charset=utf-16be"),
    (b"\xff\xfea", "text/plain; charset=utf-8"),
    (b"\xff\xfea\0", "text/plain; charset=utf-16le"),
    (b"\xef\xbb\xbf\x01", "text/plain; charset=utf-8"),
    (b"\xef\xbb\xbf", "text/plain; charset=utf-8"),
    (b"GIF87a", "image/gif"),
    (b"GIF88a", "text/plain; charset=utf-8"),
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"BMx", "image/bmp"),
    (b"RIFF\x01\x02\x0a\x04WEBPVP", "image/webp"),
    (b"RIFF\x01\x02\x0a\x04WAVE", "audio/wave"),
    (b"RIFF\x01\x02\x0a\x04AVI ", "video/avi"),
    (b"RIFF\x01\x02\x0a\x04AVI", "application/octet-stream"),
    (b"FORM....AIFF", "audio/aiff"),
    (b"\0\0\x01\0", "image/vnd.microsoft.icon"),
    (b".snd", "audio/basic"),
    (b"OggS\0", "application/ogg"),
    (b"MThd\0\0\0\x06", "audio/midi"),
    (b"ID3", "audio/mpeg"),
    (b"\x01" * 34 + b"LP", "application/vnd.ms-fontobject"),
    (b"\0\x01\0\0", "font/ttf"),
    (b"OTTO", "font/otf"),
    (b"ttcf", "font/collection"),
    (b"wOFF", "font/woff"),
    (b"wOF2", "font/woff2"),
    (b"\x1a\x45\xdf\xa3", "video/webm"),
    (b"Rar \x1a\x07\0", "application/x-rar-compressed"),
    (b"PK\x03\x04", "application/zip"),
    (b"\x1f\x8b\x08", "application/x-gzip"),
    (b"\0\0\0\x10ftypmp42\0\0\0\0", "video/mp4"),
    (b"\0\0\0\x14ftypisom\0\0\0\0mp41", "video/mp4"),
    (b"\0\0\0\x10ftypisommp42mp42", "application/octet-stream"),
    (b"\0\0\0\x18ftypisom\0\0\0\0mp41", "application/octet-stream"),
    (b"\0\0\0\x12ftypmp42\0\0\0\0\0\0\0", "application/octet-stream"),
    (b"a" * 512 + b"\0", "text/plain; charset=utf-8"),
    (b"a" * 511 + b"\0", "application/octet-stream"),
    (b"\x1b esc", "text/plain; charset=utf-8"),
]


def test_content_types(spark):
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(SAMPLES)], "i int, content binary")
    got = {r.i: r.t for r in rows.select("i", content_type(F.col("content")).alias("t")).collect()}
    wrong = [(c, got[i], want) for i, (c, want) in enumerate(SAMPLES) if got[i] != want]
    assert wrong == []


def test_paths(spark):
    rows = spark.createDataFrame([("/a/b/c",), ("a/b",), ("/x",), ("/a\0/b",)], "p string")
    got = rows.select(path_tokens(F.col("p")).alias("t"), dir_name(F.col("p")).alias("d")).collect()
    assert [r.t for r in got] == [["/a", "/a/b", "/a/b/c"], ["a", "a/b"], ["/x"], ["/a", "/a/b"]]
    assert [r.d for r in got] == ["/a/b", "a", "/", "/a\0"]


def test_bool_filter(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,), (3,), (None,)], "x int")
    x = F.col("x")

    def kept(**options):
        return [r.x for r in rows.where(bool_filter(**options)).collect()]

    assert kept() == kept(must=[match_all()]) == [0, 1, 2, 3, None]
    assert kept(must=[x > 0], should=[x > 1]) == [1, 2, 3]
    assert kept(should=[x > 1, x == 0]) == [0, 2, 3]
    assert kept(should=[x > 0, x > 1, x > 2], minimum=2) == [2, 3]


def test_archives_of_any_size_and_depth(spark, tmp_path):
    """What the batch scan finds: large archives, deep ones, damaged members, odd names."""
    root = tmp_path / "root"
    (root / "pkg").mkdir(parents=True)
    large = io.BytesIO()
    with zipfile.ZipFile(large, "w", zipfile.ZIP_STORED) as archive:
        archive.writestr("pad.bin", b"\0" * (11 << 20))
        archive.writestr("m.txt", b"member")
    (root / "large.zip").write_bytes(large.getvalue())
    deep = b"deepest"
    for _ in range(12):
        deep = tarred({"in": deep})
    (root / "deep.tar").write_bytes(deep)
    damaged = io.BytesIO()
    with zipfile.ZipFile(damaged, "w") as archive:
        archive.writestr("bad", b"a" * 5_000, zipfile.ZIP_LZMA)
        archive.writestr("good", b"good")
    data = bytearray(damaged.getvalue())
    data[40:60] = b"\xff" * 20
    (root / "damaged.zip").write_bytes(data)
    (root / "tar_in.zip.gz").write_bytes(gzip.compress(zipped({"x": b"zip in gzip"})))
    for name in ("pkg/__init__.py", ".travis.yml", "empty"):
        (root / name).write_bytes(b"")
    rows = files_with_reason(spark, str(root)).collect()
    found = {r.path[len(str(root)) + 1 :]: (r.drop_reason, r.content and bytes(r.content)) for r in rows}
    assert found["large.zip/m.txt"] == (None, b"member") and found["large.zip/pad.bin"] == ("size", None)
    assert found["deep.tar" + "/in" * 12] == (None, b"deepest")
    assert found["damaged.zip/bad"] == ("special", None) and found["damaged.zip/good"] == (None, b"good")
    assert found["tar_in.zip.gz/x"] == (None, b"zip in gzip")
    assert {"pkg/__init__.py", ".travis.yml", "empty"} <= found.keys()

    # The stream reads the same bytes from rows.
    streamed = files_to_documents(spark.read.format("binaryFile").load([str(root / "large.zip"), str(root / "deep.tar"), str(root / "damaged.zip"), str(root / "tar_in.zip.gz")]))
    batch = to_documents(files_with_reason(spark, str(root)).where("drop_reason IS NULL AND container IS NOT NULL"))
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))


def test_missing_archives_take_their_members(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    for name in ("s.zip", "t.zip"):
        (root / name).write_bytes(zipped({"m.txt": name.encode(), "d/n.txt": b"x"}))
    (root / "nul").write_bytes(b"\0")
    index = CorpusIndex(str(tmp_path / "index"))
    index_tree(spark, str(root), index)
    assert changed_paths(index.seen(spark), list_tree(spark, str(root))).count() == 0
    os.remove(root / "t.zip")
    docs, listing = index.documents(spark), list_tree(spark, str(root))
    for mode in ("file", "directory"):
        assert {r.display.split("/")[-1] for r in drop_missing(docs, listing, mode).collect()} == {"m.txt", "n.txt"}
        assert all("s.zip" in r.display for r in drop_missing(docs, listing, mode).collect())
    (root / "new").write_text("new")
    assert [r.path for r in changed_paths(index.seen(spark), list_tree(spark, str(root))).collect()] == [f"{root}/new"]


def _docs(spark, texts):
    rows = spark.createDataFrame(list(texts.items()), "path string, text string")
    return to_documents(rows.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.col("text").cast("binary").alias("content")))


def test_stored_index_is_maintained(spark, tmp_path):
    index = CorpusIndex(str(tmp_path / "index"))
    create_corpus_index(spark, index)

    def hits(pattern, k=None):
        return sorted(r.display for r in search_corpus(spark, index, pattern, k=k).collect())

    assert hits("needle") == hits("needle", 5) == []
    update_index(spark, index, _docs(spark, {"/a": "a needle", "/b": "hay", "/c": "straw"}))
    update_index(spark, index, _docs(spark, {"/d": "zebra needle"}))
    assert hits("needle") == hits("needle", 9) == ["/a", "/d"]
    assert hits("zebra", 1) == ["/d"]
    update_index(spark, index, _docs(spark, {"/a": "nothing", "/b": "needle now"}))
    assert hits("needle") == hits("needle", 9) == ["/b", "/d"]
    update_index(spark, index, gone=_docs(spark, {"/d": ""}))
    assert hits("needle") == hits("needle", 9) == ["/b"] and hits("zebra", 1) == []

    # Counts and sizes are those of an index built at once.
    once = CorpusIndex(str(tmp_path / "once"))
    create_corpus_index(spark, once)
    update_index(spark, once, index.documents(spark))
    assert sorted(map(tuple, index.frequency(spark).collect())) == sorted(map(tuple, once.frequency(spark).collect()))
    assert index.size(spark).first() == once.size(spark).first()

    # A step that did not finish is not seen.
    _docs(spark, {"/x": "needle"}).write.parquet(index.place("documents", index.last_batch(spark) + 1))
    assert hits("needle") == ["/b"]
    update_index(spark, index, _docs(spark, {"/y": "y needle"}))
    assert hits("needle") == ["/b", "/y"]
