"""Document quality by hierarchical empirical Bayes.

A classifier over simple shares of each text gives a document's evidence: the logarithm of how much
likelier its features are in good texts. Hosts and paths get posterior rates of good documents from
the classifier's posteriors of theirs: a host's rate is shrunk toward that of all documents, a path's
toward its host's, the more the fewer documents it has. How strongly follows from how much hosts and
paths differ beyond chance (moments of a beta distribution). A document's own posterior is taken out
of the rates that it is judged by. All of it is grouped aggregation of narrow rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table, training_remainder

KEEP_SCORE = 0.5
#: Bins of each feature and of the classifier's score, and pseudo-counts of a bin.
BINS, SCORE_BINS, PSEUDO = 20, 24, 0.5
#: Bounds of the prior's weight in documents.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1e4


def _bin(share: Column, scale: float = BINS) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(BINS), F.floor(share * scale))).cast("int")


def feature_bins(text: Column) -> Column:
    """A bin for each feature of a text; an empty text has a value for each as well."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    lines = F.split(text, "\n")
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    n = F.size(words)

    def share_of(count: Column, of: Column) -> Column:
        return count / F.greatest(of, F.lit(1))

    marks = size - letters - F.length(F.regexp_replace(text, r"\S+", ""))
    return F.array(
        _bin(share_of(marks, size), 40),
        _bin(share_of(F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")), letters)),
        _bin(share_of(letters, n) / 20, BINS),
        _bin(F.log2(n + F.lit(1)) / 20, BINS),
        _bin(share_of(F.size(F.array_distinct(lines)), F.size(lines))),
        _bin(share_of(F.size(F.array_distinct(words)), n)),
        _bin(share_of(F.length(F.regexp_replace(text, r"[^0-9]+", "")), size), 40),
        _bin(share_of(F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]{2,}")), n)),
        _bin(share_of(F.regexp_count(text, F.lit(r"\s[^\p{L}\p{N}\s]+\s")), n)),
    )


def _table(pairs: dict[int, float], number: Column) -> Column:
    """The value of a number in a small table; 0 for others."""
    entries = [F.lit(x) for pair in pairs.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), number), F.lit(0.0)) if entries else F.lit(0.0)


def _odds(rows: list, good: float, bad: float, bins: int) -> dict[int, float]:
    """Logarithm of how much likelier each bin is in good documents."""
    counts: dict[int, list[float]] = {}
    for number, quality, n in rows:
        counts.setdefault(number, [0.0, 0.0])[quality] += n
    share = lambda n, all_of: (n + PSEUDO) / (all_of + PSEUDO * bins)
    return {k: math.log(share(c[1], good)) - math.log(share(c[0], bad)) for k, c in counts.items()}


def evidence(features: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = (4, 2)) -> tuple[DataFrame, float]:
    """features with a column evidence, and the logarithm of the odds of a good document.

    A naive Bayes score over the bins is calibrated by its own bins. Without labels of both kinds
    there is no evidence, and the odds are even.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("mark_id"), F.col("quality").cast("int").alias("quality")).filter("mark_id IS NOT NULL AND quality IN (0, 1)")
    if held_out:
        marks = marks.filter(training_remainder("mark_id", held_out[0]) != held_out[1])
    marked = stored(features.join(marks, F.col("id") == F.col("mark_id")).select("bins", "quality"), "marked")
    sizes = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    good, bad = sizes.get(1, 0), sizes.get(0, 0)
    if not good or not bad:
        return features.withColumn("evidence", F.lit(0.0)), 0.0
    # A few hundred rows: a bin of a feature and a label each.
    numbers = marked.select(F.posexplode("bins").alias("feature", "bin"), "quality").groupBy("feature", "bin", "quality").count().collect()
    odds = {}
    for feature in {r["feature"] for r in numbers}:
        own = _odds([(r["bin"], r["quality"], r["count"]) for r in numbers if r["feature"] == feature], good, bad, BINS + 1)
        odds |= {feature * (BINS + 1) + k: x for k, x in own.items()}
    terms = F.transform("bins", lambda b, k: _table(odds, k * (BINS + 1) + b))
    naive = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    # Bins of the score are one unit wide.
    place = F.greatest(F.lit(0), F.least(F.lit(SCORE_BINS), F.floor(naive + SCORE_BINS / 2))).cast("int")
    rows = marked.select(place.alias("place"), "quality").groupBy("place", "quality").count().collect()
    calibrated = _odds([(r["place"], r["quality"], r["count"]) for r in rows], good, bad, SCORE_BINS + 1)
    # A bin that no labelled document has takes the value of the nearest that one has.
    calibrated = {k: calibrated[min(calibrated, key=lambda x: (abs(x - k), x))] for k in range(SCORE_BINS + 1)}
    return features.withColumn("evidence", _table(calibrated, place)), math.log(good / bad)


def strength(groups: DataFrame, rate: Column) -> float:
    """Weight, in documents, of the rate that groups (n, good) are shrunk to, by the method of moments."""
    chance = F.sum(rate * (1 - rate))
    spread = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - rate, 2))
    r = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.pow("n", F.lit(2.0))).alias("n2"), spread.alias("spread"), chance.alias("chance")).first()
    if not r["k"] or r["k"] < 2 or r["n"] <= 0 or r["n"] - r["n2"] / r["n"] <= 0:
        return MAX_STRENGTH
    mean = r["chance"] / r["k"]
    between = (r["spread"] - (r["k"] - 1) * mean) / (r["n"] - r["n2"] / r["n"])
    return MAX_STRENGTH if between <= 0 else min(MAX_STRENGTH, max(MIN_STRENGTH, mean / between - 1))


def _logit(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, evidence, host_posterior, path_posterior, score, keep of each row.

    Null texts count as empty; null hosts and paths are groups like any other. A host with one document
    has the rate of all others. Repeated rows count each; extra columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), feature_bins(F.col(f"`{text}`")).alias("bins"))
    features, odds = evidence(stored(rows, "features"), labels)
    features = stored(features.select("id", "host", "path", "evidence", (1 / (1 + F.exp(-(F.col("evidence") + odds)))).alias("p")), "evidence")
    paths = stored(features.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    n, good = total["n"] or 0, total["good"] or 0.0
    rate = min(1 - 1e-6, max(1e-6, (good + 1) / (n + 2)))
    of_hosts = strength(hosts, F.lit(rate))
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good"))
    paths = paths.join(hosts, "host")
    host_rate = (F.col("host_good") + of_hosts * rate) / (F.col("host_n") + of_hosts)
    of_paths = strength(paths, host_rate)
    found = features.join(paths, ["host", "path"])
    # The document itself is taken out of its host and path.
    of_host = (F.col("host_good") - F.col("p") + of_hosts * rate) / (F.col("host_n") - 1 + of_hosts)
    found = found.withColumn("host_posterior", of_host)
    of_path = (F.col("good") - F.col("p") + of_paths * F.col("host_posterior")) / (F.col("n") - 1 + of_paths)
    found = found.withColumn("path_posterior", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), of_path)))
    score = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_posterior")))))
    return found.withColumn("score", score).select("id", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= KEEP_SCORE).alias("keep"))


def query(spark, sf_dir: str) -> DataFrame:
    """Documents have a source as host, and the source's part in a language as path."""
    docs = table(spark, sf_dir, "documents")
    judged = judge(docs, table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))
    return judged.withColumnRenamed("id", "doc_id").withColumn("held_out", training_remainder("doc_id", 4) == 2)
