"""Weechat log directories: ``root/irc/<server.#channel>/<file>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.chat import conversation_from_dir
from textquarry.operators.messages import (
    MESSAGE_COLUMNS,
    cut_at_first_bad_line,
    is_bad_line,
    parse_log_lines,
)


def log_files(spark: SparkSession, root: str) -> DataFrame:
    """Log files (``file``, ``text``), one row each. Files that cannot be read are left
    out; one that is there in a listing but not here was skipped."""
    files = spark.read.format("binaryFile").option("ignoreCorruptFiles", True).load(f"{root.rstrip('/')}/irc/*/*")
    return files.select(
        F.regexp_replace("path", "^file:/+", "/").alias("file"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    )


def file_lines(text: Column) -> Column:
    """Lines of a file; a final newline starts no line, a carriage return before a
    newline is no part of it."""
    pieces = F.split(text, "\r?\n", -1)
    whole = F.when(text.endswith("\n"), F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    last_clean = F.split(F.regexp_replace(text, "\r\\z", ""), "\r?\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        whole.otherwise(F.when(text.endswith("\r"), last_clean).otherwise(pieces))
    )


def parse_weechat(files: DataFrame) -> DataFrame:
    """Messages of log files. A file is one row, so the lines after its first bad one
    are cut off in place, without a shuffle."""
    parts = F.split("file", "/")
    server, channel = conversation_from_dir(F.element_at(parts, -2))
    lines = files.select(
        "file",
        F.lit("irc").alias("protocol"),
        server.alias("server"),
        channel.alias("channel_or_person"),
        F.posexplode_outer(cut_at_first_bad_line(file_lines(F.col("text")))).alias("at", "line"),
    ).where(F.col("server").isNotNull() & F.col("line").isNotNull())
    numbered = lines.withColumn("line_no", F.col("at") + 1).drop("at")
    return parse_log_lines(numbered).select("file", "line_no", *MESSAGE_COLUMNS)


def weechat_stats(files: DataFrame) -> DataFrame:
    """One row: files read to their end, and files cut short."""
    name = F.element_at(F.split("file", "/"), -2)
    bad = F.exists(file_lines(F.col("text")), is_bad_line)
    in_log = files.where(conversation_from_dir(name)[0].isNotNull())
    return in_log.agg(
        F.count_if(~bad).alias("indexed"),
        F.count_if(bad).alias("skipped"),
    )


def read_weechat(spark: SparkSession, root: str) -> DataFrame:
    return parse_weechat(log_files(spark, root))
