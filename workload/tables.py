"""The driver's tables as inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents for work on their whole texts."""
    return table(spark, sf_dir, "documents", *(columns or ("doc_id", "text")))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: the URL without its scheme is the path."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return pages.withColumn("path", F.regexp_replace("url", "^https?:/", ""))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chat messages."""
    rows = table(spark, sf_dir, "conversations")
    sender = (
        F.when(F.col("role") == "assistant", "@Assistant")
        .when(F.col("role") == "user", "+User")
        .otherwise("System")
    )
    return rows.select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"),
        F.lit("irc").alias("protocol"),
        F.when(F.col("turn") < 2, "net.one").otherwise("net.two").alias("server"),
        F.concat(F.lit("#"), F.col("conv_id")).alias("channel_or_person"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 100 + F.col("turn")).alias("time"),
        sender.alias("from"),
        F.lit(None).cast("array<string>").alias("to"),
        F.col("text").alias("message"),
    )


MESSAGES_SQL = """
    SELECT conv_id || '-' || turn AS message_id, 'irc' AS protocol,
           CASE WHEN turn < 2 THEN 'net.one' ELSE 'net.two' END AS server,
           '#' || conv_id AS channel_or_person,
           make_timestamp((1704067200 + conv_id * 100 + turn) * 1000000) AS time,
           CASE role WHEN 'assistant' THEN '@Assistant' WHEN 'user' THEN '+User'
                     ELSE 'System' END AS sender,
           text AS message
    FROM conversations
"""
