"""Importance resampling towards a target distribution: documents whose hashed word n-grams look
like the target's are drawn more often.

Words come from byte translation and split: a 256-byte table maps the UTF-8 bytes of a text,
lower-casing A-Z and turning every other ASCII byte that is no letter or digit into a blank; bytes
of other characters stay, so words are runs of ASCII letters, digits and non-ASCII characters.
``bytes.split`` yields the words. The n-grams of 1 to ``MAX_N`` words are hashed by chained
zlib.crc32: the hash of an n-gram seeds that of the (n+1)-gram with a blank and the next word, so
no n-gram is joined as bytes. Per-task Counters of buckets are reduced by Spark.

Bucket counts of documents and target give each bucket a gain, the floored log ratio of smoothed
shares; a document's weight is the sum of gains over its features. Drawing without replacement by
Gumbel keys: score = weight + a floored Gumbel variate from the hash of the id; the highest scores
of the documents with enough words are drawn. Ranks come from a range-partitioned sort and per-
partition counts, so no task sees more than its partition.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, table

# Fixed values of the method: n-gram sizes, buckets, smoothing, draw share, word minimum, seed.
MIN_N, MAX_N = 1, 1
BUCKETS = 10_000
SMOOTHING = 10_000
DRAW_PERCENT = 10
MIN_WORDS = 20
SEED = "2024"

#: A-Z lower-cased; other ASCII bytes that are no letter or digit become blanks; bytes 128-255 stay.
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(TABLE).split()


def buckets(tokens: list[bytes], min_n: int = MIN_N, max_n: int = MAX_N, n_buckets: int = BUCKETS) -> list[int]:
    """Bucket of each feature: every run of min_n to max_n words, hashed by chained crc32."""
    out: list[int] = []
    for start in range(len(tokens)):
        h = 0
        for n in range(1, max_n + 1):
            if start + n > len(tokens):
                break
            h = zlib.crc32(tokens[start + n - 1], h) if n == 1 else zlib.crc32(b" " + tokens[start + n - 1], h)
            if n >= min_n:
                out.append(h % n_buckets)
    return out


def _counter(text_at: int, min_n: int, max_n: int, n_buckets: int):
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch, text_at):
                for text in part.column(text_at).to_pylist():
                    counts.update(buckets(words(text), min_n, max_n, n_buckets))
        if counts:
            keys = sorted(counts)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], ["bucket", "n"])

    return run


def bucket_counts(df: DataFrame, text: str = "text", min_n: int = MIN_N, max_n: int = MAX_N, n_buckets: int = BUCKETS) -> DataFrame:
    """Features per bucket over all texts of df (null: none): bucket, n. Each task reduces its
    texts into one Counter of at most n_buckets keys; Spark sums them."""
    texts = df.select(F.col(f"`{text}`").cast("string").alias("text"))
    partial = texts.mapInArrow(_counter(0, min_n, max_n, n_buckets), "bucket int, n long")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n_buckets: int = BUCKETS, smoothing: int = SMOOTHING) -> DataFrame:
    """bucket, gain: floor(1000 ln((t+1)(S+smoothing) / ((s+1)(T+smoothing)))) for every bucket."""
    spark = docs.sparkSession
    every = spark.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
    s = bucket_counts(docs).withColumnRenamed("n", "s")
    t = bucket_counts(target).withColumnRenamed("n", "t")
    joined = every.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    # Totals by a window over the n_buckets rows, which Spark takes into one task.
    every_bucket = Window.partitionBy()
    totals = joined.select("bucket", "s", "t", F.sum("s").over(every_bucket).alias("total_s"), F.sum("t").over(every_bucket).alias("total_t"))
    ratio = ((F.col("t") + 1).cast("double") * (F.col("total_s") + smoothing).cast("double")) / ((F.col("s") + 1).cast("double") * (F.col("total_t") + smoothing).cast("double"))
    return totals.select("bucket", F.floor(1000 * F.log(ratio)).cast("double").alias("gain"))


def _weigher(table_value, text_at: int, min_n: int, max_n: int, n_buckets: int):
    def run(batches):
        gain = np.frombuffer(table_value.value, np.float64)
        for batch in batches:
            for part in slices(batch, text_at):
                n_words, n_features, weight = [], [], []
                for text in part.column(text_at).to_pylist():
                    tokens = words(text)
                    keys = np.array(buckets(tokens, min_n, max_n, n_buckets), np.int64)
                    n_words.append(len(tokens))
                    n_features.append(len(keys))
                    weight.append(float(gain[keys].sum()) if len(keys) else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(weight, pa.float64())],
                    ["row", "n_words", "n_features", "weight"],
                )

    return run


def gumbel(seed: str, doc_id: Column) -> Column:
    """floor(-1000 ln(-ln((h+0.5)/2^32))), h the first 8 hex digits of sha256(seed:id); null id: empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("double")


def weighted(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, n_words, n_features and weight of each row of docs. The gain table has
    ``BUCKETS`` entries whatever the input, so it is broadcast as 8 bytes a bucket."""
    spark = docs.sparkSession
    table_rows = gains(docs.select(F.col(f"`{text}`").alias("text")), target.select(F.col(f"`{target_text}`").alias("text"))).orderBy("bucket").collect()
    gain = np.zeros(BUCKETS, np.float64)
    for row in table_rows:
        gain[row.bucket] = row.gain
    shared = spark.sparkContext.broadcast(gain.tobytes())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = rows.select("row", *[F.lit(0).cast("long").alias(c) for c in ("n_words", "n_features")], F.lit(0.0).alias("weight")).schema
    return rows.mapInArrow(_weigher(shared, 1, MIN_N, MAX_N, BUCKETS), schema).select("row.*", "n_words", "n_features", "weight")


def _numbered(batches):
    part = TaskContext.get().partitionId()
    n = 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(n, n + batch.num_rows, dtype=np.int64))], ["row", "part", "local"])
        n += batch.num_rows


def draw(weights: DataFrame, id_column: str = "doc_id", seed: str = SEED, percent: int = DRAW_PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """weights (with n_words, n_features, weight) and score and rank: of the N rows with at least
    min_words words, the floor(percent*N/100) highest scores are drawn, equal scores by smaller id
    (null ids last, then fewer features); rank is 1, 2, 3, ... in that order, null for the rest.

    Rows are range-partitioned by (eligible, score, id, ...) and sorted, so eligible rows come
    first; each task numbers its rows, and offsets come from a window over the eligible counts of
    the partitions, one row each, broadcast back. Repeated rows get consecutive ranks."""
    ident = F.col(f"`{id_column}`")
    scored = weights.withColumn("score", F.col("weight") + gumbel(seed, ident))
    order = [F.col("_eligible").desc(), F.col("score").desc(), ident.asc_nulls_last(), F.col("n_features").asc(), F.col("n_words").asc()]
    keyed = scored.select("*", (F.col("n_words") >= min_words).alias("_eligible"))
    packed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(F.struct(*[F.col(f"`{c}`") for c in keyed.columns]).alias("row"))
    schema = packed.select("row", F.lit(0).alias("part"), F.lit(0).cast("long").alias("local")).schema
    numbered = stored(packed.mapInArrow(_numbered, schema), "resample-numbered")
    counts = numbered.where(F.col("row._eligible")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy()).alias("total"))
    joined = numbered.join(F.broadcast(offsets), "part", "left")
    position = F.col("offset") + F.col("local")
    quota = F.expr(f"total * {int(percent)} div 100")
    rank = F.when(F.col("row._eligible") & (position < quota), position + 1).cast("long")
    return joined.select(*[F.col("row").getField(c).alias(c) for c in scored.columns], rank.alias("rank"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = stored(weighted(docs, table(spark, sf_dir, "benchmark")), "resample-weights")
    drawn = draw(weights)
    return drawn.select("doc_id", "n_features", F.col("weight").cast("long").alias("weight"), F.col("score").cast("long").alias("score"), "rank")
