"""SimHash near-dedup by a byte-position inverted index with count filtering.

Each distinct fingerprint is posted under its bytes at known positions. Fingerprints that differ
in d bits or fewer differ in d bytes or fewer, so they share at least 8 - d positional bytes: the
guaranteed minimum. A list for a single positional byte would hold a 256th of all fingerprints,
and tallying there is quadratic, so the lists are kept for each set of 8 - d positions and the
bytes there: a pair comes together in a list exactly when its tally reaches the minimum, with
C(8, d) postings per fingerprint. Members of a list differ in d bytes only, so there are at most
256^d of them; their tallies and differing bits are checked in the task that reads the list, which
returns a spanning tree of the links and never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, slices, stored, table, unpacked
from .components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42

#: Shingles that are hashed at a time; their number bounds memory, not the text.
_CHUNK = 200_000
#: Lists of more members look up neighbours instead of comparing pairs.
_PAIRWISE = 48


def text_fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text's word shingles, repeats included; zero without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both for ASCII only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(1, len(tokens) - words + 1)]
    ends = ends[min(words, len(tokens)) - 1 :]
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist())
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in spans])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                prints = np.array([text_fingerprint(x, words) for x in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64)), part.column(2)], ["id", "bits", "text_key"])

    return run


def text_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))


def fingerprints(df: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """id, bits (the fingerprint as a signed long) and text_key (a hash of the text) of each row."""
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), text_hash(text).alias("text_key"))
    return rows.mapInArrow(_fingerprints(words), "id long, bits long, text_key long")


def _roots(a: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each member the index of the smallest member that the links lead to."""
    label = np.arange(len(a))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def list_links(members: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, member) that span the groups of one list's sorted, distinct fingerprints."""
    if len(members) <= _PAIRWISE:
        left, right = np.triu_indices(len(members), 1)
        differ = members[left] ^ members[right]
        shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near = (shared >= 8 - max_bits) & (np.bitwise_count(differ) <= max_bits)
        left, right = left[near], right[near]
    else:
        free = int(np.bitwise_or.reduce(members ^ members[0]))
        bits = [1 << k for k in range(64) if free >> k & 1]
        lefts, rights = [], []
        for n in range(1, max_bits + 1):
            for flip in combinations(bits, n):
                near = members ^ np.uint64(sum(flip))
                at = np.minimum(np.searchsorted(members, near), len(members) - 1)
                found = np.flatnonzero(members[at] == near)
                lefts.append(found)
                rights.append(at[found])
        left, right = np.concatenate(lefts), np.concatenate(rights)
    if not len(left):
        return members[:0], members[:0]
    root = _roots(members, left, right)
    other = np.flatnonzero(root != np.arange(len(members)))
    return members[root[other]], members[other]


def _links(max_bits: int):
    def run(batches):
        held = None
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns)]
            places, keys, bits = held
            new = np.flatnonzero((places[1:] != places[:-1]) | (keys[1:] != keys[:-1])) + 1
            if len(new):
                yield from found(bits[: new[-1]], new[:-1])
                held = [x[new[-1] :] for x in held]
        if held is not None:
            yield from found(held[2], np.zeros(0, np.int64))

    def found(bits: np.ndarray, new: np.ndarray):
        bits = bits.view(np.uint64)
        bounds = np.concatenate([[0], new, [len(bits)]])
        many = np.flatnonzero(np.diff(bounds) > 1)
        links = [list_links(np.unique(bits[bounds[k] : bounds[k + 1]]), max_bits) for k in many.tolist()]
        if links:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*links))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (bits) that span all links of max_bits or fewer."""
    lists = []
    for k, kept in enumerate(combinations(range(8), 8 - max_bits)):
        mask = sum(0xFF << 8 * p for p in kept)
        mask -= (mask >> 63) << 64
        lists.append(F.struct(F.lit(k).alias("places"), F.col("bits").bitwiseAND(F.lit(mask).cast("long")).alias("key")))
    posted = distinct.select(F.explode(F.array(*lists)).alias("list"), "bits").select("list.places", "list.key", "bits")
    return posted.repartition("places", "key").sortWithinPartitions("places", "key", "bits").mapInArrow(_links(max_bits), "a long, b long")


def classes(df: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """id, bits, text_key and component_id (the smallest id reachable over links) of each row, and
    component_key, the text_key of the row with that id (the smallest, if there are several).

    A null text counts as empty; texts without words have fingerprint zero and link like any other.
    Repeated rows are in one class. Rows without an id are classed too; the component_id is null
    only if no row of the class has one. Extra columns are ignored, whatever their names.
    """
    prints = stored(fingerprints(df, id_column, text, words), "fingerprints")
    return classed(prints, fingerprint_links(prints.select("bits").distinct(), max_bits))


def classed(prints: DataFrame, links: DataFrame) -> DataFrame:
    """The classes of prints (id, bits, text_key) that links (a, b) between bits lead to, as in classes."""
    # Rows without an id come after all others.
    distinct = prints.groupBy("bits").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "text_key")).alias("rep"))
    root = components(links)
    rooted = distinct.join(root, distinct["bits"] == root["node"], "left").select("bits", "rep", F.coalesce("root", "bits").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("rep"))
    by_print = rooted.drop("rep").join(smallest, "root").select("bits", F.col("rep.id").alias("component_id"), F.col("rep.text_key").alias("component_key"))
    return prints.join(by_print, "bits").select("id", "bits", "text_key", "component_id", "component_key")


def drop_near_copies(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, all columns of df: the one with the smallest id.

    Of rows that share that id and the text one stays; of different texts that share it, one with the
    smallest hash. A class without any id keeps one row, likewise.
    """
    return kept_rows(df, classes(df, id_column, text), id_column, text)


def kept_rows(df: DataFrame, found: DataFrame, id_column: str, text: str) -> DataFrame:
    """The rows of df that stay, given its classes."""
    kept = found.filter(F.col("id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("component_key")))
    kept = kept.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("kept_id"), F.col("text_key").alias("kept_key")).distinct()
    rows = packed(df, own_id=F.coalesce(F.col(f"`{id_column}`").cast("long").cast("string"), F.lit("")), own_key=text_hash(text))
    # One shuffle of texts at most: rows are where the join needs them when repeated ones are dropped.
    rows = rows.join(kept, (F.col("own_id") == F.col("kept_id")) & (F.col("own_key") == F.col("kept_key")), "left_semi")
    return unpacked(rows.dropDuplicates(["own_id", "own_key"]), df.columns)


def query(spark, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
