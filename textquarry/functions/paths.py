"""Paths of documents, also of documents inside archives.

An archive member is described by its ``container`` (a real path) and ``entry_path``
(one string per nested archive). Both are null for plain files.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    """Everything before the last slash; ``.`` for a bare name, ``/`` at the root."""
    cut = F.regexp_replace(path, r"/[^/]*\z", "")
    return (
        F.when(~F.contains(path, F.lit("/")), F.lit("."))
        .when(cut == "", F.lit("/"))
        .otherwise(cut)
    )


def path_tokens(path: Column) -> Column:
    """Every ancestor directory and the path itself, NUL characters removed."""
    parts = F.split(F.regexp_replace(path, "\\x00", ""), "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")
    )
    return F.filter(prefixes, lambda prefix: prefix != "")


def clean_prefix(prefix: str) -> str:
    """Directory argument without NUL characters and without a final slash."""
    return prefix.replace("\x00", "").rstrip("/") or "/"


def under(path: Column, prefix: str) -> Column:
    """True if ``path`` is the directory ``prefix`` or lies below it."""
    prefix = clean_prefix(prefix)
    return (path == prefix) | path.startswith(prefix + "/")


def full_name(container: Column, entry_path: Column, path: Column) -> Column:
    """Name that identifies a file; NUL marks where an archive is entered."""
    inside = F.concat(container, F.lit("\0/"), F.array_join(entry_path, "\0/"))
    return F.coalesce(inside, path)


def display_name(container: Column, entry_path: Column, path: Column) -> Column:
    """Name for people: each archive is left with an arrow."""
    inside = F.concat(container, F.lit(" -> /"), F.array_join(entry_path, " -> /"))
    return F.coalesce(inside, path)
