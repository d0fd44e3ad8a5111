"""Ranked search over stored postings of chat messages.

``search_messages`` reads all messages for each search. For large collections this plan
stores, once, postings of terms and of word pairs; a search then reads only the row groups
of its own terms, and whole messages only for its result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.text import english_terms, shingles
from textquarry.operators.filters import bool_filter
from textquarry.operators.postings import write_postings
from textquarry.operators.ranking import bm25, collection_stats, term_postings
from textquarry.plans.chat_search import analyze, message_filters, search_messages


@dataclass(frozen=True)
class ChatIndex:
    """Where the tables of a chat index live, and how its messages are analysed."""

    path: str
    analyzer: Callable[[Column], Column] = english_terms
    key: str = "message_id"

    @property
    def fields(self) -> dict[str, Callable[[Column], Column]]:
        return {"terms": self.analyzer, "pairs": shingles}

    def messages(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/messages")

    def postings(self, spark: SparkSession, field: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{field}")

    def stats(self, spark: SparkSession, field: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{field}_stats")


def index_messages(
    messages: DataFrame, index: ChatIndex, files_per_bucket: int | None = None
) -> None:
    """Store messages, then the postings and sizes of both fields."""
    spark = messages.sparkSession
    messages.write.mode("overwrite").parquet(f"{index.path}/messages")
    stored = index.messages(spark)
    for field, analyzer in index.fields.items():
        terms = analyzer(F.col("message"))
        postings = term_postings(stored, terms, index.key)
        write_postings(postings, f"{index.path}/{field}", files_per_bucket, "term", index.key)
        stats = collection_stats(stored, terms)
        stats.coalesce(1).write.mode("overwrite").parquet(f"{index.path}/{field}_stats")


def search_chat_index(
    spark: SparkSession,
    index: ChatIndex,
    text: str,
    channel: str = "",
    sender: str = "",
    protocol: str = "",
    server: str = "",
    k: int | None = 10,
) -> DataFrame:
    """The same result as ``search_messages``; without ``text`` it is that search, which
    needs no postings. Filters are joined in as narrow columns,
    and only where there are some; texts are read for the best ``k`` only."""
    key = index.key
    query = {field: analyze(spark, text, a) for field, a in index.fields.items()}
    messages = index.messages(spark)
    if not text:
        return search_messages(messages, "", channel, sender, protocol, server, k, key)
    if not query["terms"]:
        return messages.where(F.lit(False)).withColumn("score", F.lit(0.0))
    scored = {}
    for field, terms in query.items():
        size = index.stats(spark, field).first()
        postings = index.postings(spark, field)
        scored[field] = bm25(postings, terms, size.n_docs, size.avg_length, key=key)
    hits = scored["terms"]
    if query["pairs"]:
        # Pairs add to the score of messages with a term, and bring in no others.
        pairs = scored["pairs"].withColumnRenamed("score", "pair_score")
        hits = hits.join(pairs, key, "left").select(
            key, (F.col("score") + F.coalesce("pair_score", F.lit(0.0))).alias("score")
        )
    must = message_filters(channel, sender, protocol, server)
    if must:
        hits = hits.join(messages.where(bool_filter(must)).select(key), key, "left_semi")
    if k is None:
        return messages.join(hits, key).select(*messages.columns, "score")
    best = hits.orderBy(F.desc("score"), F.asc(key)).limit(k)
    # At most k rows on this side.
    found = messages.join(F.broadcast(best), key).select(*messages.columns, "score")
    return found.orderBy(F.desc("score"), F.asc(key))
