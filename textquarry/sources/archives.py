"""Archives as rows: ZIP and TAR become their members, gzip its inflated body.

Archives are read through handles, members one after another, so that their size is
bounded by no row. Archives inside archives are entered at any depth."""

from __future__ import annotations

import gzip
import io
import lzma
import posixpath
import shutil
import stat
import tarfile
import tempfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from textquarry.operators.filters import IGNORED_DIRECTORIES, IGNORED_FILES, MAX_FILE_SIZE

NESTED_ZIP_LIMIT = 10 << 20  # fixed value: larger ZIP members are not entered
MAX_INFLATED = 1 << 30  # a Spark row holds less than 2 GiB; longer gzip bodies are dropped by size
BATCH_BYTES = 32 << 20
SPOOL_BYTES = 64 << 20
_HEAD_BYTES = 512

FILES_SCHEMA = (
    "path string, modificationTime timestamp, length bigint, content binary, "
    "kind string, container string, entry_path array<string>"
)
_BATCH_SCHEMA = pa.schema(
    [
        ("path", pa.string()),
        ("modificationTime", pa.timestamp("us", "UTC")),
        ("length", pa.int64()),
        ("content", pa.binary()),
        ("kind", pa.string()),
        ("container", pa.string()),
        ("entry_path", pa.list_(pa.string())),
    ]
)

#: What decompressors raise on damaged, encrypted or unknown data.
_DAMAGE = (
    zipfile.BadZipFile, tarfile.TarError, zlib.error, lzma.LZMAError, EOFError, OSError,
    RuntimeError, NotImplementedError, ValueError, RecursionError,
)


def expand_archives(files: DataFrame, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """Replace rows whose ``content`` is an archive by rows for its members.

    ``container`` is then the real path and ``entry_path`` one string per archive
    entered. Of members over ``max_size`` only name and size are kept. Gzip keeps its
    name and its compressed size as ``length``. What cannot be decompressed becomes a
    row of kind ``unreadable``: a member alone, if the others can be read."""

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            if row["content"] is None:
                yield row
            else:
                yield from rows_of(io.BytesIO(row["content"]), row, max_size)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [_format((value.as_py() or b"")[:_HEAD_BYTES]) is not None for value in batch.column("content")]
            packed = pa.array(packed, pa.bool_())
            plain = batch.filter(pa.compute.invert(packed))
            if plain.num_rows:
                yield plain
            yield from in_batches(rows(batch.filter(packed)))

    ordered = files.selectExpr(
        "path", "modificationTime", "length", "content", "kind", "container", "entry_path"
    )
    return ordered.mapInArrow(expand, FILES_SCHEMA)


def in_batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row["content"] or b"")
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=_BATCH_SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_BATCH_SCHEMA)


class _Forward(io.RawIOBase):
    """A handle whose first bytes have been read already, to be read forward."""

    def __init__(self, head: bytes, file):
        self.head, self.file = head, file

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        part = self.head[: len(target)]
        self.head = self.head[len(part) :]
        part = part or self.file.read(len(target))
        target[: len(part)] = part
        return len(part)


def _format(head: bytes) -> str | None:
    if head.startswith(b"PK\x03\x04"):
        return "zip"
    if head.startswith(b"\x1f\x8b\x08"):
        return "gzip"
    if head[257:262] == b"ustar":
        return "tar"
    return None


def _read(file, size: int) -> bytes:
    """Up to ``size`` bytes; fewer only at the end."""
    out = bytearray()
    while len(out) < size and (part := file.read(size - len(out))):
        out += part
    return bytes(out)


def rows_of(file, row: dict, max_size: int, inflated: bool = False) -> Iterator[dict]:
    """The rows that stand for one open file: itself, or its members. ``inflated`` marks
    the body of a gzip file, whose ``length`` is that of the packed file."""
    try:
        head = _read(file, _HEAD_BYTES)
        kind = _format(head)
        nested = row["entry_path"] is not None
        if kind == "zip" and nested and row["length"] >= NESTED_ZIP_LIMIT:
            kind = None
        if kind is None:
            yield _plain(head, file, row, MAX_INFLATED if inflated else max_size, inflated)
            return
        source = io.BufferedReader(_Forward(head, file))
        if kind == "gzip":
            with gzip.GzipFile(fileobj=source) as body:
                yield from rows_of(body, row, max_size, inflated=True)
            return
        entries = _zip_entries if kind == "zip" else _tar_entries
        for name, size, member_kind, opened in entries(file, source):
            yield from _member(row, name, size, member_kind, opened, max_size)
    except _DAMAGE:
        yield dict(row, content=None, kind="unreadable")


def _plain(head: bytes, file, row: dict, limit: int, inflated: bool) -> dict:
    if not inflated and row["length"] > limit:
        return dict(row, content=None)
    content = head + _read(file, limit + 1 - len(head)) if len(head) == _HEAD_BYTES else head
    if len(content) > limit:
        return dict(row, content=None, length=max(len(content), row["length"]))
    return dict(row, content=content)


def _member(row: dict, name: str, size: int, kind: str, opened, max_size: int) -> Iterator[dict]:
    name = posixpath.normpath(name).lstrip("/")
    member = dict(
        row,
        path=posixpath.join(row["path"], name),
        length=size,
        content=None,
        kind=kind,
        container=row["container"] or row["path"],
        entry_path=[*(row["entry_path"] or []), name],
    )
    if kind != "file" or _ignored(name):
        yield member
        return
    try:
        with opened() as file:
            yield from rows_of(file, member, max_size)
    except _DAMAGE:
        yield dict(member, kind="unreadable")


def _ignored(name: str) -> bool:
    """True for names that the name filter drops, which need not be read."""
    *folders, last = name.split("/")
    return last in IGNORED_FILES or not {*IGNORED_DIRECTORIES, *IGNORED_FILES}.isdisjoint(folders)


def _zip_entries(file, source) -> Iterator[tuple]:
    """Entries of a ZIP. Its directory is at the end, so it needs a handle that can seek;
    a body that cannot is spooled by this task first."""
    with tempfile.SpooledTemporaryFile(SPOOL_BYTES) as spool:
        seekable = file.seekable() and not isinstance(file, gzip.GzipFile | zipfile.ZipExtFile)
        if seekable:
            file.seek(0)
        else:
            shutil.copyfileobj(source, spool)
            file = spool
        with zipfile.ZipFile(file) as archive:
            for info in archive.infolist():
                if not info.is_dir():
                    kind = "symlink" if stat.S_ISLNK(info.external_attr >> 16) else "file"
                    yield info.filename, info.file_size, kind, lambda info=info: archive.open(info)


def _tar_entries(file, source) -> Iterator[tuple]:
    with tarfile.open(fileobj=source, mode="r|") as archive:
        for info in archive:
            if not info.isdir():
                kind = "file" if info.isreg() else "symlink" if info.issym() else "other"
                yield info.name, info.size, kind, lambda info=info: archive.extractfile(info)
