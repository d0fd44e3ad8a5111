"""Near copies by the Jaccard similarity of word shingles.

1. Texts with the same set of five-word shingles are one set, named by a hash of it.
2. Each set is posted under 36 keys, each a hash of 7 of its min-hashes. Two sets of similarity s share
   a key with probability 1 - (1 - s^7)^36: 0.9998 at 0.8, and more above. Nothing else is left to chance.
3. Each member of a list is verified against the list's smallest one, then the members that this
   does not connect against all others of the list. So a list of copies costs as many comparisons as
   it has members, and yet all of its pairs are either connected or compared.
4. A pair is verified on the shingles of its texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .components import components
from .simhash import classed, kept_rows, text_hash

SHINGLE_WORDS = 5
#: Least similarity of near copies.
MIN_JACCARD = 0.8
BANDS, BAND_HASHES = 36, 7
SEED = 42

#: Shingles that are hashed at a time, and of which min-hashes are taken at a time.
_CHUNK, _MIN_CHUNK = 200_000, 512
_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 31, BANDS * BAND_HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _RANDOM.integers(0, 1 << 32, BANDS * BAND_HASHES).astype(np.uint32)


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted, distinct hashes of a text's word shingles; a shorter text is one, no words are none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both for ASCII only
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(1, len(tokens) - words + 1)]
    ends = ends[min(words, len(tokens)) - 1 :]
    digest, parts = xxhash.xxh64_digest, []
    for at in range(0, len(starts), _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist())
        parts.append(np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), ">u8"))
    return np.unique(np.concatenate(parts).astype(np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted, distinct hashes; two empty sets are equal."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def band_keys(hashes: np.ndarray) -> list[int]:
    """The keys, as signed longs, of the lists that a set is posted in; an empty set is in none."""
    if not len(hashes):
        return []
    low, least = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), _MIN_CHUNK):
        np.minimum(least, (low[at : at + _MIN_CHUNK, None] * _FACTORS + _OFFSETS).min(axis=0), out=least)
    rows = least.reshape(BANDS, -1)
    keys = np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], np.uint64)
    return keys.view(np.int64).tolist()


def _sets(batches):
    for batch in batches:
        for part in slices(batch, 1):
            names, sizes, keys = [], [], []
            for text in part.column(1).to_pylist():
                hashes = shingles(text)
                names.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                sizes.append(len(hashes))
                keys.append(band_keys(hashes))
            bits = pa.array(np.array(names, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), bits, part.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "bits", "text_key", "size", "keys"])


def _verified(min_jaccard: float):
    def run(batches):
        last, held = None, None
        for batch in batches:
            a, b, near = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for x, left, right in zip(a, batch.column(2), batch.column(3)):
                if x != last:
                    last, held = x, shingles(left.as_py())
                near.append(jaccard(held, shingles(right.as_py())) >= min_jaccard)
            pairs = [(x, y) for x, y, n in zip(a, b, near) if n]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"])

    return run


def _verify(pairs: DataFrame, texts: DataFrame, min_jaccard: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts, given by bits, are near copies."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("bits")).distinct()
    needed = stored(texts.join(needed, "bits", "left_semi"), "compared-texts")
    both = pairs.join(needed.select(F.col("bits").alias("b"), F.col("text").alias("right")), "b")
    both = both.join(needed.select(F.col("bits").alias("a"), F.col("text").alias("left")), "a")
    return stored(both.select("a", "b", "left", "right").mapInArrow(_verified(min_jaccard), "a long, b long"), "near-pairs")


def links(sets: DataFrame, texts: DataFrame, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """Links (a, b) that connect all near copies among sets (bits, size, keys); texts has bits and text."""
    posted = sets.select("bits", "size", F.explode("keys").alias("key"))
    lists = posted.groupBy("key").agg(F.count("*").alias("n"), F.min("bits").alias("hub")).filter("n > 1").drop("n")
    members = stored(posted.join(lists, "key"), "members")
    first = stored(members.filter("bits <> hub").select(F.col("hub").alias("a"), F.col("bits").alias("b")).distinct(), "first-pairs")
    found = _verify(first, texts, min_jaccard)

    # What one pass does not connect, within each list.
    root = components(found)
    members = members.join(root, F.col("bits") == F.col("node"), "left").select("key", "bits", "size", F.coalesce("root", "bits").alias("root"))
    members = stored(members, "rooted-members")
    main = members.groupBy("key", "root").count().groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("count", "root"))["root"].alias("main")).filter("roots > 1").drop("roots")
    members = members.join(main, "key")
    apart = members.filter("root <> main").select("key", F.col("bits").alias("x"), F.col("size").alias("x_size"), F.col("root").alias("x_root"))
    pairs = apart.join(members, "key").filter((F.col("root") != F.col("x_root")) & ((F.col("root") == F.col("main")) | (F.col("bits") < F.col("x"))))
    pairs = pairs.filter(F.least("size", "x_size") >= F.lit(min_jaccard) * F.greatest("size", "x_size"))
    pairs = pairs.select(F.least("bits", "x").alias("a"), F.greatest("bits", "x").alias("b")).distinct()
    second = stored(pairs.join(first, ["a", "b"], "left_anti"), "second-pairs")
    return found.union(_verify(second, texts, min_jaccard))


def classes(df: DataFrame, id_column: str = "doc_id", text: str = "text", min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """Rows as simhash.classes gives them, linked by similarity; bits is a hash of the shingles."""
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), text_hash(text).alias("text_key"))
    rows = stored(rows.mapInArrow(_sets, "id long, bits long, text_key long, size long, keys array<long>"), "shingle-sets")
    # Equal sets have equal keys: one text stands for all.
    sets = rows.groupBy("bits").agg(F.first("size").alias("size"), F.first("keys").alias("keys"), F.min("text_key").alias("text_key"))
    texts = df.select(F.col(f"`{text}`").cast("string").alias("text"), text_hash(text).alias("text_key"))
    texts = texts.join(sets.filter("size > 0").select("bits", "text_key"), "text_key").dropDuplicates(["bits"]).select("bits", "text")
    return classed(rows.select("id", "bits", "text_key"), links(sets, texts, min_jaccard))


def drop_near_copies(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, all columns of df, as simhash.drop_near_copies chooses it."""
    return kept_rows(df, classes(df, id_column, text), id_column, text)
