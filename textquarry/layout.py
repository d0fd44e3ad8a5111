"""Where intermediate tables go."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def prepare_session(spark: SparkSession) -> None:
    """Runtime settings this library gains from: id filters of up to the size a search
    makes reach the Parquet scan value by value, not only as a range."""
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", "1000")


def durable_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared place the cluster names in ``spark.checkpoint.dir``,
    deleted when the driver ends. Where that is unset, as in tests on one machine, in a
    temporary folder that is made once."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark.sparkContext.master)
    if not _made:
        atexit.register(_delete_made)
    _made.append(f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


@functools.cache
def _own_folder(master: str) -> str:
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return "file://" + tempfile.mkdtemp(prefix="textquarry-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh folder and read again, so that its size is known."""
    return _stored_at(df, durable_dir(df.sparkSession, name))


def _stored_at(df: DataFrame, place: str) -> DataFrame:
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


@contextlib.contextmanager
def stored_meanwhile(df: DataFrame, name: str):
    """``df`` as :func:`stored` gives it, until the block ends."""
    place = durable_dir(df.sparkSession, name)
    try:
        yield _stored_at(df, place)
    finally:
        _delete(place)


def _delete(place: str) -> None:
    with contextlib.suppress(Exception):
        files, inside = fs.FileSystem.from_uri(place)
        files.delete_dir(inside)


def _delete_made() -> None:
    for place in _made:
        _delete(place)
