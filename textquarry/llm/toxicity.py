"""Toxicity by a counterfactual-regularised linear classifier.

Labelled texts give counts of words and of the beginnings of words (stems, so that inflected forms
share evidence). The features that tell the labels apart best, chosen by grouped counts in Spark,
get weights by logistic regression. In labelled sentences that name a group of people, the name is
swapped for the others of its kind; the squared change of the score between a sentence and its
counterfactuals is part of the loss, so that a mention as such comes to carry no weight.

The classifier is fitted on at most MAX_LABELLED rows, those with the smallest hash of their id;
everything else covers all rows and whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import opened, share, slices, stored, table, training_remainder

#: Bound of the labelled rows that the classifier is fitted on.
MAX_LABELLED = 20_000
#: Bound of the features that get a weight.
MAX_FEATURES = 1_024
THRESHOLD = 0.3

#: Names of groups that may be swapped for each other, by kind and language.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés"),
    ("frauen", "männer", "muslime", "christen", "juden", "einwanderer"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
_STEMS = range(4, 9)


def word_features(word: str) -> list[str]:
    """The word itself, marked, and its beginnings."""
    return ["=" + word, *[word[:k] for k in _STEMS if k <= len(word)]]


def word_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def swaps(text: str | None, kinds: Iterable[tuple[str, ...]]) -> Counter:
    """How often each (term, other term of its kind) is a counterfactual of a sentence of the text."""
    found, others = Counter(), {t: [o for o in kind if o != t] for kind in kinds for t in kind}
    for sentence in _SENTENCE.split((text or "").lower()):
        for term in others.keys() & set(_WORD.findall(sentence)):
            found.update((term, other) for other in others[term])
    return found


@dataclass
class Model:
    """weights by feature; score is the logistic function of bias plus their sum over the counts."""

    bias: float
    weights: dict[str, float]

    def scorer(self):
        known: dict[str, list[float]] = {}
        numbers = {f: k for k, f in enumerate(self.weights)}
        values = list(self.weights.values())

        def score(text: str | None) -> float:
            if len(known) > 500_000:
                known.clear()
            counts: dict[int, int] = {}
            for word, n in word_counts(text).items():
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = [numbers[f] for f in word_features(word) if f in numbers]
                for k in ids:
                    counts[k] = counts.get(k, 0) + n
            z = self.bias + sum(values[k] * math.log1p(n) for k, n in sorted(counts.items()))
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

        return score


def _count_features(batches):
    """feature, toxic, n: in how many texts a feature occurs."""
    counts = {0: Counter(), 1: Counter()}

    def drain():
        for toxic, held in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([toxic] * len(held), pa.int32()), pa.array(list(held.values()), pa.int64())], ["feature", "toxic", "n"])
            held.clear()

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic].update({f for word in word_counts(text) for f in word_features(word)})
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield from drain()
    yield from drain()


def _vectors(numbers: dict[str, int], kinds):
    """Counts of the chosen features and swaps of each labelled text."""

    def run(batches):
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = Counter()
                for word, n in word_counts(text).items():
                    for f in word_features(word):
                        if f in numbers:
                            held[numbers[f]] += n
                pairs = swaps(text, kinds)
                out.append({"toxic": toxic, "ids": list(held), "counts": list(held.values()), "swaps": [{"a": a, "b": b, "n": n} for (a, b), n in pairs.items()]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("toxic", pa.int32()), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("swaps", pa.list_(pa.struct([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])))]))

    return run


def fit_weights(rows, columns, values, toxic, differences, shares, n_features, balance=1.0, ridge=1e-4, steps=600):
    """Bias and weights: logistic loss, a small ridge, and balance times the mean squared score change."""
    w, b = np.zeros(n_features), math.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5))
    mean, spread, rate = np.zeros(n_features + 1), np.zeros(n_features + 1), 0.1
    for step in range(1, steps + 1):
        z = b + np.bincount(rows, w[columns] * values, len(toxic))
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - toxic) / len(toxic)
        g = np.bincount(columns, error[rows] * values, n_features) + ridge * w
        if len(shares):
            g += 2 * balance * differences.T @ (shares * (differences @ w))
        g = np.append(g, error.sum())
        mean, spread = 0.9 * mean + 0.1 * g, 0.999 * spread + 0.001 * g * g
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        if step > steps // 2:
            rate *= 0.99
    return b, w


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, held_out: tuple[int, int] | None = (4, 2)) -> DataFrame:
    """text and toxic of at most limit labelled rows; held_out (modulus, remainder) leaves rows out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("mark_id"), F.col("toxic").cast("int").alias("toxic")).filter("mark_id IS NOT NULL AND toxic IN (0, 1)")
    if held_out:
        marks = marks.filter(training_remainder("mark_id", held_out[0]) != held_out[1])
    # Rows with a small hash first, so that few are left to sort, whatever their number.
    share = 1.1 * limit / max(1, marks.count())
    if share < 1:
        marks = marks.filter(F.pmod(F.xxhash64("mark_id"), F.lit(1 << 32)) < int(share * (1 << 32)))
    marks = marks.orderBy(F.pmod(F.xxhash64("mark_id"), F.lit(1 << 32)), "mark_id", "toxic").limit(limit)
    # At most limit rows of two numbers are broadcast, so no text is moved.
    return docs.join(F.broadcast(marks), docs["doc_id"].cast("long") == marks["mark_id"]).select(F.col("text").cast("string").alias("text"), "toxic")


def train(docs: DataFrame, labels: DataFrame, kinds=IDENTITY_TERMS, limit: int = MAX_LABELLED, features: int = MAX_FEATURES, balance: float = 1.0) -> Model | None:
    """A model, or None where there is no labelled row to learn from."""
    sample = stored(labelled_sample(docs, labels, limit), "labelled")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes:
        return None
    n1, n0 = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    counts = sample.mapInArrow(_count_features, "feature string, toxic int, n long").groupBy("feature").agg(F.sum(F.expr("IF(toxic = 1, n, 0)")).alias("a"), F.sum(F.expr("IF(toxic = 0, n, 0)")).alias("b"))
    # Squared difference of the shares over its variance, pulled down for few rows.
    p, q, both = F.col("a") / n1, F.col("b") / n0, (F.col("a") + F.col("b") + 1) / (n1 + n0 + 2)
    gain = (p - q) * (p - q) / (both * (1 - both) + 1e-9)
    chosen = counts.filter("a + b >= 3").orderBy(gain.desc(), "feature").limit(features).select("feature").collect()
    names = [r["feature"] for r in chosen]
    names += sorted({f for kind in kinds for term in kind for f in word_features(term)} - set(names))
    numbers = {f: k for k, f in enumerate(names)}
    vectors = sample.mapInArrow(_vectors(numbers, kinds), "toxic int, ids array<int>, counts array<long>, swaps array<struct<a:string,b:string,n:long>>").collect()
    rows = np.repeat(np.arange(len(vectors)), [len(v["ids"]) for v in vectors])
    columns = np.array([k for v in vectors for k in v["ids"]], np.int64)
    values = np.log1p(np.array([n for v in vectors for n in v["counts"]], float))
    pairs = Counter()
    for v in vectors:
        pairs.update({(s["a"], s["b"]): s["n"] for s in v["swaps"]})
    differences = np.zeros((len(pairs), len(names)))
    for k, (term, other) in enumerate(pairs):
        for f in word_features(term):
            differences[k, numbers[f]] += math.log(2)
        for f in word_features(other):
            differences[k, numbers[f]] -= math.log(2)
    shares = np.array(list(pairs.values()), float)
    b, w = fit_weights(rows, columns, values, np.array([v["toxic"] for v in vectors], float), differences, shares / max(1.0, shares.sum()), len(names), balance)
    return Model(float(b), {f: float(x) for f, x in zip(names, w) if x})


def _scores(model):
    def run(batches):
        score = opened(model).scorer()
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([score(x) for x in part.column(1).to_pylist()], pa.float64())], ["row", "score"])

    return run


def score(docs: DataFrame, model: Model | None, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """row (a struct of the kept columns) and score of each row; without a model the score is 0.

    A null text counts as empty; an empty text has the score of the bias alone. Equal texts have
    equal scores. Extra columns are never an input, whatever their names.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select("row", F.lit(0.0).alias("score"))
    model = share(docs.sparkSession, model)  # bounded by the number of features
    return rows.mapInArrow(_scores(model), rows.select("row", F.lit(0.0).alias("score")).schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    scored = scored.select(F.col("row.doc_id").alias("doc_id"), "score")
    return scored.select("doc_id", (training_remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    scored = score(docs, train(docs, labels), docs.columns).filter(F.col("score") < THRESHOLD)
    return scored.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
