"""File filters and document predicates, all as boolean or string columns."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.content_type import content_type
from textquarry.functions.paths import base_name, dir_name
from textquarry.functions.text import normalize_username

# Names that are not indexed, the default size limit, and how many bytes
# are looked at to tell binary files.
IGNORED_DIRECTORIES = [".git", ".svn", ".sass-cache", ".yardoc", "__MACOSX"]
IGNORED_FILES = [".DS_Store"]
MAX_FILE_SIZE = 10_485_760
BINARY_PROBE_BYTES = 4096


def special_file_filter(kind: Column) -> Column:
    """True for devices, pipes, sockets and symbolic links."""
    return kind != "file"


def name_filter(
    path: Column,
    root: str = "",
    directories: Sequence[str] = tuple(IGNORED_DIRECTORIES),
    files: Sequence[str] = tuple(IGNORED_FILES),
) -> Column:
    """True for files in an ignored directory, and files or directories with an ignored
    name. Directories above ``root`` do not count."""
    above = dir_name(F.lit(root.rstrip("/"))) if root else F.lit("")
    parts = F.split(
        F.when(path.startswith(F.concat(above, F.lit("/"))), F.substr(path, F.length(above) + 2))
        .otherwise(path),
        "/",
    )
    inside = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    ignored = F.array(*map(F.lit, [*directories, *files]))
    return F.arrays_overlap(inside, ignored) | base_name(path).isin(list(files))


def size_filter(length: Column, max_size: int = MAX_FILE_SIZE) -> Column:
    """True for files larger than ``max_size``."""
    return length > max_size


def binary_filter(content: Column) -> Column:
    """True if a NUL byte is among the first 4096 bytes."""
    return F.contains(F.substring(content, 1, BINARY_PROBE_BYTES), F.lit(b"\0"))


def drop_reason(
    path: Column,
    length: Column,
    content: Column,
    kind: Column,
    max_size: int = MAX_FILE_SIZE,
    root: str = "",
    extra: Sequence[tuple[str, Column]] = (),
) -> Column:
    """First filter that drops a file (``special``, ``name``, ``size``, ``binary``, then
    the user's own ``extra`` ones), null for files to index."""
    reason = (
        F.when(special_file_filter(kind), "special")
        .when(name_filter(path, root), "name")
        .when(size_filter(length, max_size), "size")
        .when(binary_filter(content), "binary")
    )
    for name, drop in extra:
        reason = reason.when(drop, name)
    return reason


def index_stats(files: DataFrame, reason: str = "drop_reason") -> DataFrame:
    """One row: files indexed and files skipped."""
    return files.agg(
        F.count_if(F.col(reason).isNull()).alias("indexed"),
        F.count_if(F.col(reason).isNotNull()).alias("skipped"),
    )


def content_type_profile(files: DataFrame, content: str = "content") -> DataFrame:
    """Files and bytes by content type."""
    typed = files.select(
        content_type(F.col(content)).alias("content_type"), F.length(content).alias("n_bytes")
    )
    return typed.groupBy("content_type").agg(
        F.count("*").alias("files"), F.sum("n_bytes").alias("bytes")
    )


def term(column: Column, value) -> Column:
    """Exact keyword match."""
    return column == F.lit(value)


def match_username(column: Column, value: str) -> Column:
    """Equal user names, sigils and case aside."""
    return normalize_username(column) == normalize_username(F.lit(value))


def match_any_username(column: Column, value: str) -> Column:
    """True if one of an array of user names is equal, sigils and case aside."""
    return F.exists(column, lambda name: match_username(name, value))


def match_all() -> Column:
    return F.lit(True)


def match_none() -> Column:
    return F.lit(False)


def bool_filter(
    must: Sequence[Column] = (), should: Sequence[Column] = (), minimum: int = 0
) -> Column:
    """All of ``must``, and at least ``minimum`` of ``should``. Without ``must``, a
    filter of only ``should`` needs one of them; an empty filter matches all."""
    parts = list(must)
    if should:
        minimum = max(minimum, 0 if must else 1)
    if minimum > 0:
        hits = [F.when(clause, 1).otherwise(0) for clause in should]
        parts.append(functools.reduce(operator.add, hits, F.lit(0)) >= minimum)
    return functools.reduce(operator.and_, parts, match_all())


def hit_fields(hits: DataFrame) -> DataFrame:
    """What a search returns of a document: never its text."""
    return hits.select("doc_id", "name", "path")
