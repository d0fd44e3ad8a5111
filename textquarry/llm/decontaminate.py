"""Benchmark decontamination by latent semantic retrieval.

1. The benchmark's terms in all documents are stored by passage, and their document frequencies counted.
2. A randomised SVD of the TF-IDF matrix of the benchmark items and of all passages of all
   documents is computed in Spark: tasks sum their rows' shares of A'A, or where it has too many
   terms to be dense, of A'AG and of Q'A'AQ.
3. Windows of every document, one from each term that has weight, are folded into the latent space
   and compared with the items of their length by cosine. Words that are not of the benchmark take
   no part in that, however many they are and however often an item leaks.
4. Candidates are verified: longest common subsequence of words with the item, and whether the
   item's answer (its last sentence) is there.

The benchmark is the query set and is searched for in blocks; all rows of documents are searched.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import opened, share, slices, stored_meanwhile, table

#: Items that are searched for in one pass, about; it bounds what is broadcast.
BLOCK_ITEMS = 1_024
#: Words of the passages that the SVD is fitted on, besides the items themselves.
FIT_WORDS = 40
RANK, OVERSAMPLING = 128, 16
#: Tasks that sum shares of a product, by blocks of so many terms.
SUM_TASKS, SUM_TERMS = 8, 512
#: Up to so many terms a task's share of A'A is a dense matrix, and passages are read once.
DENSE_TERMS = 4_096
#: Terms of texts counted, of passages multiplied, and pairs of terms added up at once.
TERMS_AT_ONCE, PRODUCTS_AT_ONCE, PAIRS_AT_ONCE = 1 << 20, 1 << 13, 1 << 18
#: Terms in a larger share of all documents have no weight, unless an item has few others.
COMMON_SHARE, FEW_TERMS = 0.03, 6
#: Least cosine in the latent space.
MIN_COSINE = 0.5
#: Share of an item's words that is a leak by itself, and together with the answer.
LEAK_SHARE, LEAK_SHARE_WITH_ANSWER, ANSWER_SHARE = 0.8, 0.5, 0.8

#: Texts searched at a time; a position that has weight takes RANK numbers of memory.
SEARCH_BYTES = 1 << 20
#: Distinct words of a text held against all items of a block at once.
WORDS_AT_ONCE = 16_384
#: Words of a text times items whose neighbourhoods are counted at once.
COUNTS_AT_ONCE = 1 << 20

_SPACES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_SENTENCE = re.compile(r"[.!?\n]+")


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()


def answer_length(text: str) -> int:
    """Words of the last sentence, or of the last fifth if that is all of the text."""
    sentences = [s for s in map(tokens, _SENTENCE.split(text)) if s]
    return len(sentences[-1]) if len(sentences) > 1 else max(1, sum(map(len, sentences)) // 5)


def common_subsequence(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Which words of a passage of that length, given by the positions of each, are in the longest
    common subsequence with words: its length, by whole-word arithmetic on bit rows."""
    full = (1 << length) - 1
    row = full
    for word in words:
        mask = masks.get(word)
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return length - row.bit_count()


def window_lengths(length: int) -> int:
    """The window for items of this length: the next of a series with ratio 1.5."""
    size = 8
    while size < length:
        size = size * 3 // 2
    return size


class Index:
    """What tasks need to search for one block of items; its size is that of the block."""

    def __init__(self, items: list[tuple[int, list[bytes], int]], vocabulary: dict[bytes, int], idf: np.ndarray, latent: np.ndarray):
        self.vocabulary, self.idf = vocabulary, idf
        self.latent = (latent * idf[:, None]).astype(np.float32)
        self.sizes: dict[int, list[int]] = {}
        self.items = []
        vectors = []
        # How often each item has each word; the last column is for words of none.
        wide = max((len(words) for _, words, _ in items), default=0) >= 1 << 16
        self.count = np.zeros((len(items), len(vocabulary) + 1), np.uint32 if wide else np.uint16)
        self.answer_count = np.zeros_like(self.count)
        for k, (item, words, answer) in enumerate(items):
            ids = [vocabulary[w] for w in words]
            self.items.append((item, len(ids), _positions(ids), answer, _positions(ids[-answer:])))
            np.add.at(self.count[k], ids, 1)
            np.add.at(self.answer_count[k], ids[-answer:], 1)
            vectors.append(self.latent[ids].sum(axis=0))
            self.sizes.setdefault(window_lengths(len(ids)), []).append(k)
        vectors = np.array(vectors, np.float32).reshape(len(items), -1)
        self.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        # Window of each item, its words, and how many of its answer's words are the answer.
        self.window = np.array([window_lengths(n) for _, n, *_ in self.items], np.int64)
        self.length = np.array([n for _, n, *_ in self.items], np.int64)
        self.answer = np.array([ANSWER_SHARE * answer for _, _, _, answer, _ in self.items], np.float64)

    def search(self, texts: list[str | None], min_cosine: float) -> list[list[dict]]:
        """Leaks in each text.

        A leak needs a common subsequence of ``LEAK_SHARE`` of the item's words, or of half of them
        and one of ``ANSWER_SHARE`` of its answer's (:meth:`verify`). A subsequence takes each
        word no more often than both the item (or answer) and the neighbourhood have it, and the
        neighbourhood is part of the text. So an item for which the sums over words of the
        lesser of the two counts, item and whole text, and answer and whole text, are too small cannot
        be found in the text. Those items are left out per text before any cosine, by a pass over the
        text's distinct words, and then those that no neighbourhood can hold (:meth:`_in_reach`); the result is that of comparing every window with every item."""
        found: list[dict[int, dict]] = [{} for _ in texts]
        get = self.vocabulary.get
        for held, words in zip(found, map(tokens, texts)):
            ids = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
            if not len(ids):
                continue
            distinct, counts = np.unique(ids, return_counts=True)
            share = _held(self.count, distinct, counts) / self.length
            candidates = np.flatnonzero(share >= LEAK_SHARE_WITH_ANSWER)
            if len(candidates):
                answered = _held(self.answer_count[candidates], distinct, counts) >= self.answer[candidates]
                candidates = candidates[(share[candidates] >= LEAK_SHARE) | answered]
            if len(candidates):
                candidates = self._in_reach(ids, candidates)
            if len(candidates):
                self._search_text(held, ids, candidates, min_cosine)
        return [[hit for hit in held.values() if hit["lcs_share"] >= LEAK_SHARE or hit["answer_found"]] for held in found]

    def _search_text(self, held: dict[int, dict], ids: np.ndarray, candidates: np.ndarray, min_cosine: float) -> None:
        places = np.flatnonzero(np.append(self.idf, 0.0)[ids] > 0)
        if not len(places):
            return
        sums = np.zeros((len(places) + 1, self.latent.shape[1]))
        np.cumsum(self.latent[ids[places]], axis=0, out=sums[1:])
        for size in np.unique(self.window[candidates]).tolist():
            numbers = candidates[self.window[candidates] == size].tolist()
            last = np.searchsorted(places, np.minimum(places + size, len(ids)))
            # With all items of the size, as the last bits of a product depend on its shape.
            vectors, columns = self.vectors[self.sizes[size]].T, np.searchsorted(self.sizes[size], numbers)
            for at in range(0, len(places), 4096):
                part = slice(at, min(at + 4096, len(places)))
                folded = (sums[last[part]] - sums[part]).astype(np.float32)
                cosine = (folded @ vectors)[:, columns] / np.maximum(np.linalg.norm(folded, axis=1), 1e-6)[:, None]
                for w, n in zip(*(x.tolist() for x in np.nonzero(cosine >= min_cosine))):
                    self.verify(held, numbers[n], float(cosine[w, n]), int(places[at + w]), size, ids, 0, len(ids))

    def _in_reach(self, ids: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """The candidates of which the neighbourhood of some window holds half of the words, counted as in
        :meth:`search`. The others cannot be found, by the same bound.

        Of the occurrences of a word that the item has n times, a neighbourhood counts its first n: each
        counts for those that reach it and begin after the occurrence n before it. So it adds one to
        a run of windows, and running sums over where runs begin and end give all windows."""
        weighed = np.append(self.idf, 0.0)[ids] > 0
        windows = np.concatenate([[0], np.cumsum(weighed)])  # that begin before each word
        if not windows[-1]:
            return candidates[:0]
        at = np.flatnonzero(ids >= 0)
        words = ids[at]
        order = np.argsort(words, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        first = np.searchsorted(words[order], words)
        width = int(windows[-1]) + 1
        step = max(1, COUNTS_AT_ONCE // (len(words) + width))
        kept = []
        for k in range(0, len(candidates), step):
            group = candidates[k : k + step]
            counts = self.count[group[:, None], words]
            row, place = np.nonzero(counts)
            half = self.window[group][row] // 2
            before = rank[place] - counts[row, place].astype(np.int64)
            begin = at[place] - self.window[group][row] - 2 * half
            begin = np.where(before >= first[place], np.maximum(begin, at[order[np.maximum(before, 0)]]), begin)
            begin, end = (windows[np.clip(x + half + 1, 0, len(ids))] + row * width for x in (begin, at[place]))
            change = np.bincount(begin, minlength=len(group) * width) - np.bincount(end, minlength=len(group) * width)
            present = np.cumsum(change.reshape(len(group), width)[:, :-1], axis=1).max(axis=1)
            kept.append(group[present / self.length[group] >= LEAK_SHARE_WITH_ANSWER])
        return np.concatenate(kept)

    def verify(self, held: dict[int, dict], k: int, cosine: float, start: int, size: int, ids: np.ndarray, low: int, high: int) -> None:
        """Compare words around a candidate window, unless a window just before was compared with the item."""
        item, length, masks, answer, answer_masks = self.items[k]
        hit = held.setdefault(k, {"item_id": item, "cosine": cosine, "lcs_share": 0.0, "answer_found": False, "at": -size})
        hit["cosine"] = max(hit["cosine"], cosine)
        if hit["lcs_share"] == 1.0 or 0 <= start - hit["at"] < size // 4:
            return
        hit["at"] = start
        near = ids[max(low, start - size // 2) : min(high, start + size + size // 2)]
        # The subsequence is no longer than the words that the item has.
        places = np.flatnonzero(self.count[k, near] > 0)
        if len(places) < LEAK_SHARE_WITH_ANSWER * length:
            return
        words = near[places].tolist()
        share = common_subsequence(masks, length, words) / length
        if share < LEAK_SHARE_WITH_ANSWER:
            hit["lcs_share"] = max(hit["lcs_share"], share)
            return
        # A window may be longer than the item; what counts is a neighbourhood of the item's own length.
        answered = common_subsequence(answer_masks, answer, words) >= ANSWER_SHARE * answer
        width, best, found, last = length // 2 + length * 3 // 2, 0.0, False, None
        starts = np.arange(max(1, len(near) - width + 1))
        for part in zip(np.searchsorted(places, starts).tolist(), np.searchsorted(places, starts + width).tolist()):
            if part == last:
                continue
            last, held_words = part, words[slice(*part)]
            here = common_subsequence(masks, length, held_words) / length
            best = max(best, here)
            if answered and here >= LEAK_SHARE_WITH_ANSWER:
                found |= common_subsequence(answer_masks, answer, held_words) >= ANSWER_SHARE * answer
            if best == share and found == answered:
                break
        hit["lcs_share"] = max(hit["lcs_share"], best)
        hit["answer_found"] |= found


def _held(own: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each row, the sum over distinct words of the lesser of the row's count and the given one."""
    held = np.zeros(len(own), np.int64)
    for at in range(0, len(words), WORDS_AT_ONCE):
        part = slice(at, at + WORDS_AT_ONCE)
        held += np.minimum(own[:, words[part]], counts[part]).sum(axis=1, dtype=np.int64)
    return held


def _positions(ids: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for place, word in enumerate(ids):
        masks[word] = masks.get(word, 0) | 1 << place
    return masks


def _terms(vocabulary):
    """The terms of each text in order, with a -2 between passages."""

    def run(batches):
        get = vocabulary.value.get
        for batch in batches:
            for part in slices(batch, 0):
                terms, bounds = [], [0]
                for text in part.column(0).to_pylist():
                    words = tokens(text)
                    ids = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                    ids = np.insert(ids, np.arange(FIT_WORDS, len(ids), FIT_WORDS), -2)
                    terms.append(ids[ids != -1])
                    bounds.append(bounds[-1] + len(terms[-1]))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(terms)))], ["terms"])

    return run


def _lists(batches, limit: int):
    """Bounds of rows and the values of their lists, for rows with about limit values at a time."""
    for batch in batches:
        bounds = batch.column(0).offsets.to_numpy()
        values = [c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py() :] for c in batch.columns]
        bounds = bounds - bounds[0]
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
            yield bounds[at : end + 1] - bounds[at], *(v[bounds[at] : bounds[end]] for v in values)
            at = end


def _document_frequencies(n_terms: int):
    def run(batches):
        counts, rows = np.zeros(n_terms, np.int64), 0
        for bounds, terms in _lists(batches, TERMS_AT_ONCE):
            rows += len(bounds) - 1
            held = (np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * n_terms + terms)[terms >= 0]
            counts += np.bincount(np.unique(held) % n_terms, minlength=n_terms)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *found.tolist()], pa.int32()), pa.array([rows, *counts[found].tolist()], pa.int64())], ["term", "n"])

    return run


def _fit_rows(idf: np.ndarray):
    """TF-IDF rows (terms, weights) of all passages that have terms of weight."""

    def run(batches):
        for bounds, terms in _lists(batches, TERMS_AT_ONCE):
            breaks = terms < 0
            weighed = (idf[terms] > 0) & ~breaks
            if not weighed.any():
                continue
            passage = (np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) + np.cumsum(breaks))[weighed]
            row = np.concatenate([[0], np.cumsum(passage[1:] != passage[:-1])])
            held, n = np.unique(row * len(idf) + terms[weighed], return_counts=True)
            row, term = held // len(idf), held % len(idf)
            bounds = pa.array(np.searchsorted(row, np.arange(row[-1] + 2)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, x) for x in (pa.array(term, pa.int32()), pa.array(n * idf[term], pa.float64()))]
            yield pa.RecordBatch.from_arrays(lists, ["terms", "weights"])

    return run


def _gram(n_terms: int):
    """A task's share of A'A, in blocks of rows."""

    def run(batches):
        total = np.zeros(n_terms * n_terms)
        for bounds, terms, weights in _lists(batches, TERMS_AT_ONCE):
            sizes = np.diff(bounds)
            first, near = (np.repeat(x, sizes) for x in (bounds[:-1], sizes))  # of the row of each term
            ends = np.append(0, np.cumsum(near, dtype=np.int64))
            at = 0
            while at < len(terms):
                end = max(at + 1, int(np.searchsorted(ends, ends[at] + PAIRS_AT_ONCE, side="right")) - 1)
                n = near[at:end]
                one = np.repeat(np.arange(at, end), n)
                other = np.arange(len(one)) + np.repeat(first[at:end] - (ends[at:end] - ends[at]), n)
                np.add.at(total, terms[one].astype(np.int64) * n_terms + terms[other], weights[one] * weights[other])
                at = end
        total = total.reshape(n_terms, n_terms)
        for at in range(0, n_terms, SUM_TERMS):
            yield _blocks({at: total[at : at + SUM_TERMS]})

    return run


def _gram_product(basis):
    def run(batches):
        q = basis.value
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield _blocks({block: np.frombuffer(part, np.float32).reshape(-1, len(q)) @ q})

    return run


def _product(basis, symmetric: bool):
    """A task's share of A'(A basis), or of (A basis)'(A basis), in blocks of rows."""

    def run(batches):
        q = basis.value
        total = np.zeros((q.shape[1] if symmetric else q.shape[0], q.shape[1]))
        for bounds, terms, weights in _lists(batches, PRODUCTS_AT_ONCE):
            sizes = np.diff(bounds)
            if not len(terms):
                continue
            w = weights.astype(np.float32)[:, None]
            y = np.add.reduceat(w * q[terms], bounds[:-1][sizes > 0])
            if symmetric:
                total += y.T @ y
                continue
            row = np.repeat(np.arange(len(y)), sizes[sizes > 0])
            order = np.argsort(terms, kind="stable")
            held = terms[order]
            first = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
            total[held[first]] += np.add.reduceat(w[order] * y[row[order]], first)
        yield _blocks({at: total[at : at + SUM_TERMS] for at in range(0, len(total), SUM_TERMS)})

    return run


def _blocks(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    shares = [x.astype(np.float32).tobytes() for x in held.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(shares, pa.binary())], ["block", "share"])


def _sum_blocks(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held[block] = held.get(block, 0) + np.frombuffer(part, np.float32).astype(float)
    for block, total in held.items():
        yield _blocks({block: total})


def _summed(shares: DataFrame) -> DataFrame:
    return shares.repartition(SUM_TASKS, "block").mapInArrow(_sum_blocks, _BLOCKS)


_BLOCKS = "block int, share binary"


def right_singular_vectors(rows: DataFrame, n_terms: int, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors (n_terms x rank) of the rows (terms, weights).

    What tasks send is summed in tasks, so that the driver gets the terms of a block of items by the rank."""
    width = min(n_terms, rank + OVERSAMPLING)
    context = rows.sparkSession.sparkContext

    def collected(blocks: DataFrame) -> np.ndarray:
        return np.concatenate([np.frombuffer(r["share"], np.float32) for r in sorted(blocks.collect())]).astype(float).reshape(-1, width)

    def shared(basis: np.ndarray):
        return context.broadcast(basis.astype(np.float32))

    def leading(product, square) -> np.ndarray:
        basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, width)))[0]
        for _ in range(2):
            basis = np.linalg.qr(product(basis))[0]
        values, vectors = np.linalg.eigh(square(basis))
        return basis @ vectors[:, np.argsort(-values)[:rank]]

    if n_terms <= DENSE_TERMS:
        with stored_meanwhile(_summed(rows.mapInArrow(_gram(n_terms), _BLOCKS)), "products") as gram:
            product = lambda basis: collected(gram.mapInArrow(_gram_product(shared(basis)), _BLOCKS))
            return leading(product, lambda basis: basis.T @ product(basis))
    with stored_meanwhile(rows, "passages") as held:
        total = lambda basis, symmetric: collected(_summed(held.mapInArrow(_product(shared(basis), symmetric), _BLOCKS)))
        return leading(lambda basis: total(basis, False), lambda basis: total(basis, True))


def build_index(docs: DataFrame, items: list[tuple[int, str]], id_column: str, rank: int = RANK) -> Index:
    """The index of a block of items: weights and latent space are those of all rows of docs."""
    spark = docs.sparkSession
    parsed = [(item, tokens(text), answer_length(text)) for item, text in items]
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, words, _ in parsed for w in words}))}
    texts = docs.select(F.col("text").cast("string").alias("text"))
    terms = texts.mapInArrow(_terms(spark.sparkContext.broadcast(vocabulary)), "terms array<int>")
    with stored_meanwhile(terms, "terms") as terms:
        counted = terms.mapInArrow(_document_frequencies(len(vocabulary)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        df = np.zeros(len(vocabulary) + 1)
        for r in counted:
            df[r["term"]] = r["n"]  # the last one is the number of documents
        n = max(1.0, df[-1])
        idf = np.log((n + 1) / (df[:-1] + 1)) + 1e-3
        weighed = df[:-1] <= COMMON_SHARE * n
        for _, words, _ in parsed:
            ids = {vocabulary[w] for w in words}
            if sum(weighed[k] for k in ids) < min(FEW_TERMS, len(ids)):
                weighed[list(ids)] = True
        idf = np.where(weighed, idf, 0.0)
        rows = terms.mapInArrow(_fit_rows(idf), "terms array<int>, weights array<double>")
        own = [Counter(vocabulary[w] for w in words) for _, words, _ in parsed]
        own = [(list(c), [float(x * idf[t]) for t, x in c.items()]) for c in own]
        own = spark.createDataFrame(own, "terms array<int>, weights array<double>").coalesce(1)
        latent = right_singular_vectors(rows.union(own), len(vocabulary), min(rank, len(vocabulary)))
    return Index(parsed, vocabulary, idf, latent)


def _search(index, min_cosine: float):
    hit = pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs_share", pa.float64()), ("answer_found", pa.bool_())])

    def run(batches):
        searched = opened(index)
        for batch in batches:
            for part in slices(batch, 1, SEARCH_BYTES):
                leaks = searched.search(part.column(1).to_pylist(), min_cosine)
                leaks = [[{f.name: x[f.name] for f in hit} for x in held] for held in leaks]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(leaks, pa.list_(hit))], ["row", "leaks"])

    return run


_LEAKS = "array<struct<item_id:bigint,cosine:double,lcs_share:double,answer_found:boolean>>"


def item_blocks(benchmark: DataFrame, block: int = BLOCK_ITEMS):
    """Blocks of (item_id, text), each collected when it is used. Items without words are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    blocks = max(1, math.ceil(items.count() / block))
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        if found := sorted(((r["item_id"], r["text"]) for r in rows if tokens(r["text"])), key=repr):
            yield found


def search(docs: DataFrame, items: list[tuple[int, str]], keep: tuple[str, ...], id_column: str = "doc_id", min_cosine: float = MIN_COSINE, corpus: DataFrame | None = None) -> DataFrame:
    """row (a struct of the kept columns) and leaks of each row of docs, for one block of items.

    Frequencies and passages are those of corpus, or of docs. A null or empty text has no leaks.
    Repeated rows and items are searched each.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").cast("string").alias("text"))
    index = share(docs.sparkSession, build_index(docs if corpus is None else corpus, items, id_column))
    schema = rows.select("row", F.lit(None).cast(_LEAKS).alias("leaks")).schema
    return rows.mapInArrow(_search(index, min_cosine), schema)


def leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row for each document and item that it leaks: ids, cosine, lcs_share, answer_found."""
    found = None
    for items in item_blocks(benchmark):
        part = search(docs, items, (id_column,), id_column, min_cosine).select(F.col("row").getField(id_column).alias(id_column), F.inline("leaks"))
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.limit(0).select(id_column, F.inline(F.lit(None).cast(_LEAKS)))
    return found


def drop_leaking(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of docs without leaks, with all their columns."""
    corpus = docs
    for items in item_blocks(benchmark):
        clean = search(docs, items, tuple(docs.columns), id_column, corpus=corpus).filter(F.size("leaks") == 0)
        docs = clean.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
