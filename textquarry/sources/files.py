"""File trees as rows: ``path``, ``modificationTime``, ``length``, ``content``, ``kind``,
``container`` and ``entry_path`` (the last two are null but for members of archives).

Names are listed first, all of them, in tasks; what is dropped by kind, name or size is
never opened, and archives are read through their open file, whatever their size. Local
paths are walked with the operating system's calls, which tell links from files; URIs of
other file systems through pyarrow."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.layout import durable_dir
from textquarry.operators.filters import MAX_FILE_SIZE, name_filter, special_file_filter
from textquarry.sources.archives import FILES_SCHEMA, in_batches, rows_of

LISTING_SCHEMA = "path string, modificationTime timestamp, length bigint, kind string"
ENTRIES_PER_WALK = 1_000


def scan_files(
    spark: SparkSession, root: str, max_size: int = MAX_FILE_SIZE, partitions: int | None = None
) -> DataFrame:
    """All files below ``root``, hidden, underscored and empty ones too, archives replaced
    by their members. The bytes of plain files over ``max_size`` are not read."""
    return read_files(list_tree(spark, root), root, max_size, partitions)


def list_tree(spark: SparkSession, root: str, entries_per_walk: int = ENTRIES_PER_WALK) -> DataFrame:
    """Every file below ``root`` with its kind (``file``, ``symlink``, ``other``); links
    are not followed.

    Tasks walk directories; after so many entries a walk hands the directories it has not
    reached to the next round, where they are spread over all tasks, so no subtree stays
    with one. Each round is written; the driver sees only whether there is another."""
    place, at = durable_dir(spark, "listing"), 0
    spread = 4 * spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string")
    while True:
        walked = frontier.repartition(spread, "path").mapInPandas(_walk(entries_per_walk), LISTING_SCHEMA)
        walked.write.parquet(f"{place}/round={at}")
        rest = spark.read.schema(LISTING_SCHEMA).parquet(f"{place}/round={at}")
        frontier, at = rest.where("kind = 'directory'").select("path"), at + 1
        if frontier.isEmpty():
            listed = spark.read.schema(f"{LISTING_SCHEMA}, round int").parquet(place)
            return listed.where("kind <> 'directory'").drop("round")


def _is_local(path: str) -> bool:
    return path.startswith("file:") or "://" not in path


def _local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _scan(directory: str) -> tuple[list[str], list[tuple]]:
    """Directories and files of one directory; one that cannot be read has none."""
    try:
        return _scan_local(_local(directory)) if _is_local(directory) else _scan_remote(directory)
    except OSError:
        return [], []


def _scan_local(directory: str) -> tuple[list[str], list[tuple]]:
    directories, files = [], []
    for entry in sorted(os.scandir(directory), key=lambda e: e.name):
        try:
            info = entry.stat(follow_symlinks=False)
        except OSError:
            continue
        if stat.S_ISDIR(info.st_mode):
            directories.append(entry.path)
            continue
        kind = "file" if stat.S_ISREG(info.st_mode) else "other"
        kind = "symlink" if stat.S_ISLNK(info.st_mode) else kind
        modified = datetime.fromtimestamp(info.st_mtime_ns // 1_000_000 / 1000, UTC)
        files.append((entry.path, modified, info.st_size, kind))
    return directories, files


def _scan_remote(directory: str) -> tuple[list[str], list[tuple]]:
    system, inside = fs.FileSystem.from_uri(directory)
    directories, files = [], []
    for info in system.get_file_info(fs.FileSelector(inside)):
        path = f"{directory.rstrip('/')}/{info.base_name}"
        if info.type == fs.FileType.Directory:
            directories.append(path)
        else:
            files.append((path, info.mtime, info.size, "file" if info.is_file else "other"))
    return directories, files


def _walk(entries_per_walk: int):
    names = ["path", "modificationTime", "length", "kind"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in batch["path"]:
                pending, seen = [start], 0
                while pending and seen < entries_per_walk:
                    directories, files = _scan(pending.pop())
                    pending += directories
                    seen += len(files) + len(directories)
                    if files:
                        yield pd.DataFrame(files, columns=names)
                if pending:
                    rows = [(path, pd.NaT, 0, "directory") for path in pending]
                    yield pd.DataFrame(rows, columns=names)

    return walk


def open_file(path: str):
    """A seekable handle of a file on any file system."""
    if _is_local(path):
        return open(_local(path), "rb")
    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)


def read_files(
    listing: DataFrame, root: str = "", max_size: int = MAX_FILE_SIZE, partitions: int | None = None
) -> DataFrame:
    """Files with their bytes, archives replaced by their members. Special files and
    ignored names are kept as rows but not opened; files that cannot be opened get the
    kind ``unreadable``. Names are spread over tasks before any byte is read."""
    spark = listing.sparkSession
    partitions = partitions or 4 * spark.sparkContext.defaultParallelism
    skipped = special_file_filter(F.col("kind")) | name_filter(F.col("path"), root)
    spread = listing.withColumn("skipped", skipped).repartition(partitions, "path")

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        for listed in batch.to_pylist():
            row = {k: listed[k] for k in ("path", "modificationTime", "length", "kind")}
            row |= {"content": None, "container": None, "entry_path": None}
            if listed["skipped"]:
                yield row
                continue
            try:
                file = open_file(row["path"])
            except OSError:
                yield dict(row, kind="unreadable")
                continue
            with file:
                yield from rows_of(file, row, max_size)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from in_batches(rows(batch))

    return spread.mapInArrow(read, FILES_SCHEMA)
