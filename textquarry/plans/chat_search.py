"""Ranked, filtered search over chat messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from textquarry.functions.text import english_terms, shingles
from textquarry.operators.filters import bool_filter, match_username, term
from textquarry.operators.ranking import bm25_weight


def analyze(spark, text: str, analyzer: Callable[[Column], Column]) -> list[str]:
    """Terms of a query text; a job on one row."""
    return spark.range(1).select(analyzer(F.lit(text)).alias("terms")).first().terms


def message_filters(channel: str, sender: str, protocol: str, server: str) -> list[Column]:
    """Exact filters on messages; an empty value is no filter."""
    exact = {"channel_or_person": channel, "protocol": protocol, "server": server}
    must = [term(F.col(column), value) for column, value in exact.items() if value]
    if sender:
        must.append(match_username(F.col("from"), sender))
    return must


def _field_score(tokens: Column, counts: list[Column], stats: Row, field: str) -> Column:
    """BM25 of one analysed field, from the counts of the query terms in it."""
    score = F.lit(0.0)
    for at, tf in enumerate(counts):
        weight = bm25_weight(
            tf,
            F.lit(stats[f"{field}_df_{at}"]),
            F.size(tokens),
            F.lit(stats[f"{field}_n"]),
            F.lit(stats[f"{field}_average"]),
        )
        score = score + F.when(tf > 0, weight).otherwise(0.0)
    return score


def search_messages(
    messages: DataFrame,
    text: str = "",
    channel: str = "",
    sender: str = "",
    protocol: str = "",
    server: str = "",
    k: int | None = 10,
    key: str = "message_id",
    analyzer: Callable[[Column], Column] = english_terms,
) -> DataFrame:
    """Messages that pass the exact filters and hold any term of ``text``, best first.

    Word pairs of ``text`` add to the score only. Without ``text`` the newest come
    first. Term statistics are those of all messages, as in an inverted index; they are
    one aggregate row. The search itself is one narrow pass and a top-k."""
    must = message_filters(channel, sender, protocol, server)
    if not text:
        found = messages.where(bool_filter(must)).withColumn("score", F.lit(0.0))
        order = [F.desc("time"), F.asc(key)]
    else:
        found = _text_hits(messages, text, must, analyzer)
        order = [F.desc("score"), F.asc(key)]
    return found if k is None else found.orderBy(*order).limit(k)


def _text_hits(messages, text, must, analyzer) -> DataFrame:
    spark = messages.sparkSession
    fields = {"terms": analyzer, "pairs": shingles}
    query = {f: analyze(spark, text, a) for f, a in fields.items()}
    if not query["terms"]:
        return messages.where(F.lit(False)).withColumn("score", F.lit(0.0))

    def count_of(field: str, wanted: str) -> Column:
        return F.size(F.filter(field, lambda t: t == wanted))

    # A term repeated in the query scores once per repeat.
    counts = {f: [count_of(f, wanted) for wanted in query[f]] for f in fields}
    analysed = messages.select(
        "*", *[a(F.col("message")).alias(f) for f, a in fields.items()]
    )
    aggregates = []
    for f in fields:
        length = F.size(f)
        aggregates.append(F.count_if(length > 0).alias(f"{f}_n"))
        aggregates.append(F.avg(F.when(length > 0, length)).alias(f"{f}_average"))
        for at, wanted in enumerate(query[f]):
            has = F.array_contains(f, wanted)
            aggregates.append(F.count_if(has).alias(f"{f}_df_{at}"))
    stats = analysed.agg(*aggregates).first()
    score = F.lit(0.0)
    for f in fields:
        score = score + _field_score(F.col(f), counts[f], stats, f)
    any_term = F.arrays_overlap("terms", F.array(*map(F.lit, query["terms"])))
    hits = analysed.where(bool_filter([*must, any_term]))
    return hits.withColumn("score", score).drop(*fields)
