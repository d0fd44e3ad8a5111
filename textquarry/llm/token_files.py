"""Token ids of documents in files of patched frame-of-reference blocks, and read back from them.

Ids are cut into blocks of ``BLOCK`` values. A block stores its minimum; every value is stored as
its difference from it, packed at the bit width that holds the ``PERCENTILE``-th percentile of the
differences. Differences that need more bits are exceptions: their places and full differences
follow the packed bits. An index of block starts lets a reader seek to any block.

File layout (little-endian): blocks, then a footer of document ids (int64), their validity (one
byte each), their id counts (uint64) and the block starts (uint64, from the file's start), then a
trailer of n_values, n_documents, n_blocks, footer start (uint64 each) and the magic bytes.
Block: minimum (uint32), width (uint8), count (uint16), exceptions (uint16); ceil(count/8)*width
bytes of packed differences, value after value, low bits first; exception places (uint16) and
differences (uint32).

The writer is a Spark job: documents are range-partitioned by (doc_id, digest) at splitters that
Spark samples and sorted in each partition, so that each task writes one file of ascending ids
and a key held by many rows is cut over several files. A task writes its file under a temporary
name and moves it into place, so a retried task leaves one whole file. Readers take one file a
task and stream it block by block; memory is bounded by the footer of one file.
"""

from __future__ import annotations

import os
import struct
import zlib
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import safe_pieces
from .common import new_path, slices, stored, table

#: Values per block, a multiple of 8 and at most 65,535.
BLOCK = 1024
#: Percentile of a block's differences that its packed width holds; larger ones are exceptions.
PERCENTILE = 90
#: Blocks packed together by numpy.
CHUNK_BLOCKS = 64
#: Characters of texts coded at once.
GROUP_CHARACTERS = 4 << 20
#: Bytes of pieces that the library codes at once, and of pieces and their ids that a Python worker keeps.
PIECE_BYTES, KEPT_BYTES = 32 << 10, 24 << 20
#: The id put after each document (fixed value of the format's contract).
END_ID = 1
MAGIC = b"TQPFOR01"

# Printable ASCII (without the apostrophe of the pattern's contractions and the bar of
# its added tokens) and composed Latin letters, whose lower case is one letter.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_SIGNS = r"!-&(-/:-@\[-`{}~"
_PLAIN = f"[{_LETTERS}0-9{_SIGNS}]+"
_PIECE = f"([{_LETTERS}]+|[0-9]|[{_SIGNS}]+)"

_HEAD = "<IBHH"
_TRAIL = "<QQQQ8s"
_HEAD_SIZE, _TRAIL_SIZE = struct.calcsize(_HEAD), struct.calcsize(_TRAIL)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits needed for each value (0 for 0)."""
    out = np.zeros(values.shape, np.int64)
    positive = values > 0
    out[positive] = np.floor(np.log2(values[positive].astype(np.float64))).astype(np.int64) + 1
    return out


def encode_blocks(values: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of an array of unsigned 32-bit values, each as bytes."""
    values = np.asarray(values, np.uint32)
    out: list[bytes] = []
    for start in range(0, len(values), block * CHUNK_BLOCKS):
        out += _encode_chunk(values[start : start + block * CHUNK_BLOCKS], block, percentile)
    return out


def _encode_chunk(values: np.ndarray, block: int, percentile: float) -> list[bytes]:
    n = len(values)
    nb = -(-n // block)
    padded = np.zeros(nb * block, np.int64)
    padded[:n] = values
    rows = padded.reshape(nb, block)
    counts = np.full(nb, block, np.int64)
    counts[-1] = n - (nb - 1) * block
    valid = np.arange(block)[None, :] < counts[:, None]
    base = np.where(valid, rows, np.int64(1) << 40).min(axis=1)
    diff = np.where(valid, rows - base[:, None], 0)
    chosen = np.zeros(nb, np.int64)
    full = counts == block
    if full.any():
        chosen[full] = np.percentile(diff[full], percentile, axis=1, method="higher")
    for k in np.flatnonzero(~full).tolist():
        chosen[k] = np.percentile(diff[k, : counts[k]], percentile, method="higher")
    width = _widths(chosen)
    exception = valid & ((diff >> width[:, None]) != 0)
    kept = np.where(exception, 0, diff)
    packed: dict[int, np.ndarray] = {}
    for w in np.unique(width).tolist():
        if w:
            sel = width == w
            bits = ((kept[sel][:, :, None] >> np.arange(w)) & 1).astype(np.uint8).reshape(int(sel.sum()), block * w)
            packed[w] = np.packbits(bits, axis=1, bitorder="little")
    seen = {w: 0 for w in packed}
    out = []
    for k in range(nb):
        w, count = int(width[k]), int(counts[k])
        places = np.flatnonzero(exception[k]).astype("<u2")
        body = b""
        if w:
            body = packed[w][seen[w], : -(-count // 8) * w].tobytes()
            seen[w] += 1
        out.append(struct.pack(_HEAD, int(base[k]), w, count, len(places)) + body + places.tobytes() + diff[k, places].astype("<u4").tobytes())
    return out


def decode_block(data: bytes | memoryview, at: int = 0) -> np.ndarray:
    """The values of the block that starts at ``at``."""
    base, w, count, n_exc = struct.unpack_from(_HEAD, data, at)
    at += _HEAD_SIZE
    values = np.zeros(count, np.int64)
    if w:
        size = -(-count // 8) * w
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little").reshape(-1, w)
        values = (bits.astype(np.int64) << np.arange(w)).sum(axis=1)[:count]
        at += size
    places = np.frombuffer(data, "<u2", n_exc, at)
    values[places] = np.frombuffer(data, "<u4", n_exc, at + 2 * n_exc)
    return (values + base).astype(np.uint32)


def encode_file(doc_ids: list, lengths: list[int], blocks: list[bytes]) -> bytes:
    """A whole file in memory, for tests and small tables; tasks write the same bytes streaming."""
    starts = np.cumsum([0] + [len(b) for b in blocks[:-1]]).astype("<u8") if blocks else np.zeros(0, "<u8")
    body = b"".join(blocks)
    return body + _footer(doc_ids, lengths, starts, len(body))


def _footer(doc_ids: list, lengths: list[int], starts: np.ndarray, footer_at: int) -> bytes:
    valid = np.array([k is not None for k in doc_ids], np.uint8)
    ids = np.array([k if k is not None else 0 for k in doc_ids], "<i8")
    counts = np.array(lengths, "<u8")
    trailer = struct.pack(_TRAIL, int(counts.sum()), len(ids), len(starts), footer_at, MAGIC)
    return ids.tobytes() + valid.tobytes() + counts.tobytes() + np.asarray(starts, "<u8").tobytes() + trailer


def read_footer(handle) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Document ids, validity, id counts and block starts of an open file, and its size."""
    size = handle.size()
    handle.seek(size - _TRAIL_SIZE)
    n_values, n_docs, n_blocks, footer_at, magic = struct.unpack(_TRAIL, handle.read(_TRAIL_SIZE))
    if magic != MAGIC:
        raise ValueError("not a token id file")
    handle.seek(footer_at)
    raw = handle.read(size - _TRAIL_SIZE - footer_at)
    ids = np.frombuffer(raw, "<i8", n_docs, 0)
    valid = np.frombuffer(raw, np.uint8, n_docs, 8 * n_docs)
    counts = np.frombuffer(raw, "<u8", n_docs, 9 * n_docs)
    starts = np.frombuffer(raw, "<u8", n_blocks, 17 * n_docs)
    return ids, valid, counts, np.append(starts, np.uint64(footer_at)), n_values


def document_digests(handle) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per document of an open file, streaming its blocks: id, validity, first place, count and
    the unsigned crc32 of its ids as little-endian 32-bit integers."""
    ids, valid, counts, starts, _ = read_footer(handle)
    crcs = np.zeros(len(ids), np.int64)
    doc, remaining, crc = 0, int(counts[0]) if len(counts) else 0, 0
    for first in range(0, len(starts) - 1, CHUNK_BLOCKS):
        last = min(first + CHUNK_BLOCKS, len(starts) - 1)
        handle.seek(int(starts[first]))
        data = handle.read(int(starts[last] - starts[first]))
        for k in range(first, last):
            values = decode_block(data, int(starts[k] - starts[first]))
            pos = 0
            while pos < len(values):
                while remaining == 0:
                    crcs[doc], doc, crc = crc, doc + 1, 0
                    remaining = int(counts[doc])
                take = min(remaining, len(values) - pos)
                crc = zlib.crc32(values[pos : pos + take].astype("<u4").tobytes(), crc)
                pos, remaining = pos + take, remaining - take
    if remaining:
        raise ValueError("file ends inside a document")
    while doc < len(ids):
        crcs[doc], doc, crc = crc, doc + 1, 0
        if doc < len(ids) and counts[doc]:
            raise ValueError("file ends inside a document")
    places = np.concatenate([[0], np.cumsum(counts.astype(np.int64))[:-1]]) if len(counts) else np.zeros(0, np.int64)
    return ids, valid, places, counts.astype(np.int64), crcs


class Coder:
    """Ids of whole texts by the tokenizers library, which codes each distinct piece of them once.

    The model drops white space and lets no token reach across it, so the ids of a text are those of
    its parts between ASCII white space, one after another. A part of plain characters only
    (``_PLAIN``) is cut further, into the pieces that the model's own pattern finds in it (letters, one
    digit, signs), in lower case, as the model makes them. Any other part stays one piece. Every
    piece goes through the whole tokenizer. Pieces and their ids are kept until they take more than
    ``kept`` bytes; then they are dropped, and pieces that come again are coded again."""

    def __init__(self, tokenizer, kept: int = KEPT_BYTES):
        self.tokenizer, self.kept = tokenizer, kept
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids = pa.array([], pa.large_list(pa.uint32()))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        coded = parts.flatten().dictionary_encode()
        ids = self._of_parts(coded.dictionary).take(coded.indices)
        bounds = ids.offsets.to_numpy()[parts.offsets.to_numpy()].tolist()
        flat = ids.values.to_numpy()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]

    def _of_parts(self, parts: pa.StringArray) -> pa.LargeListArray:
        """The ids of each part; parts are distinct and without white space."""
        plain = pc.match_substring_regex(parts, f"^{_PLAIN}$")
        cut = pc.replace_substring_regex(pc.utf8_lower(parts), _PIECE, "\\1\n")
        pieces = pc.split_pattern(pc.if_else(plain, cut, parts), "\n")
        coded = pieces.flatten().dictionary_encode()
        ids = self._of_pieces(coded.dictionary).take(coded.indices)
        return pa.LargeListArray.from_arrays(ids.offsets.take(pieces.offsets), ids.values)

    def _of_pieces(self, pieces: pa.StringArray) -> pa.LargeListArray:
        """The ids of each piece; pieces are distinct."""
        if self.known.nbytes + self.ids.nbytes > self.kept:
            self._forget()
        places = pc.index_in(pieces, self.known)
        new = pieces.filter(places.is_null())
        numbers = places.fill_null(0).to_numpy().copy()
        numbers[places.is_null().to_numpy(zero_copy_only=False)] = np.arange(len(self.known), len(self.known) + len(new))
        groups = slices(pa.RecordBatch.from_arrays([new], ["piece"]), 0, PIECE_BYTES)
        self.ids = pa.concat_arrays([self.ids, *[self._coded(group.column(0).to_pylist()) for group in groups]])
        self.known = pa.concat_arrays([self.known, new])
        return self.ids.take(pa.array(numbers))

    def _coded(self, pieces: list[str]) -> pa.LargeListArray:
        """The ids of each piece by the library: the place of an id's first character tells its piece."""
        if len(pieces) == 1:
            encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
            ids = encode(pieces, add_special_tokens=False)[0].ids
            return pa.LargeListArray.from_arrays([0, len(ids)], pa.array(ids, pa.uint32()))
        coded = self.tokenizer.encode("\n".join(pieces), add_special_tokens=False)
        places = np.fromiter(map(itemgetter(0), coded.offsets), np.int64)
        first = np.cumsum([0, *[len(p) + 1 for p in pieces]])
        return pa.LargeListArray.from_arrays(np.searchsorted(places, first), pa.array(coded.ids, pa.uint32()))


def _shared_coder(model: Broadcast) -> Coder:
    """The coder of this Python worker. A worker opens the broadcast once, so its tasks share the
    tokenizer and the ids of pieces; in a new worker the coder begins without any."""
    held = model.value
    if "coder" not in held:
        # One thread per task: Spark runs a task per core already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        held["coder"] = Coder(Tokenizer.from_str(held["model"]))
    return held["coder"]


def _coder(model, characters: int, end_id: int, group_characters: int):
    def run(batches):
        coder = _shared_coder(model)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for part in slices(batch, 1, group_characters):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids_of: list[list[np.ndarray]] = [[] for _ in texts]
                group: list[str] = []
                owners: list[int] = []
                held = 0
                for k, text in enumerate(texts):
                    for piece in safe_pieces(text, characters):
                        group.append(piece)
                        owners.append(k)
                        held += len(piece)
                        if held >= group_characters:
                            for owner, ids in zip(owners, coder.encode(group)):
                                ids_of[owner].append(ids)
                            group, owners, held = [], [], 0
                for owner, ids in zip(owners, coder.encode(group) if group else []):
                    ids_of[owner].append(ids)
                out = [np.concatenate([*parts, end]).tobytes() for parts in ids_of]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())], ["row", "n_tokens", "ids"]
                )
                # Arrow's allocator holds on to what the group took, beside the memory of the JVM.
                pa.default_memory_pool().release_unused()

    return run


def encode_ids(
    df: DataFrame, tokenizer_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), end_id: int = END_ID, characters: int = 50_000, group_characters: int = GROUP_CHARACTERS
) -> DataFrame:
    """Kept columns, n_tokens and ids (little-endian uint32) of each row, by the tokenizers
    library without added special tokens, with end_id after each text. A null text counts as
    empty (its ids are end_id alone). Long texts are encoded in pieces cut before a blank or line
    feed that follows a non-blank; the model drops white space, so the ids are those of the whole.
    Texts are taken in groups of about group_characters, so that a task holds the ids and words of
    one group only, however long a text is; see :class:`Coder` for how a group is coded. The model file is read on the driver; its size is that of a vocabulary."""
    with open(tokenizer_file, encoding="utf-8") as file:
        model = df.sparkSession.sparkContext.broadcast({"model": file.read()})
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = rows.select("row", F.lit(0).cast("long").alias("n_tokens"), F.lit(b"").alias("ids")).schema
    return rows.mapInArrow(_coder(model, characters, end_id, group_characters), schema).select("row.*", "n_tokens", "ids")


def _writer(folder: str, block: int, percentile: float):
    def run(batches):
        part = TaskContext.get().partitionId()
        attempt = TaskContext.get().taskAttemptId()
        files, inside = fs.FileSystem.from_uri(folder)
        files.create_dir(inside, recursive=True)
        final = f"{inside}/part-{part:05d}.ids"
        temporary = f"{final}.{attempt}.tmp"
        doc_ids, lengths, starts, at, pending, held = [], [], [], 0, [], 0
        with files.open_output_stream(temporary) as out:

            def flush(values, last):
                nonlocal at
                whole = len(values) if last else len(values) - len(values) % block
                for data in encode_blocks(values[:whole], block, percentile):
                    starts.append(at)
                    out.write(data)
                    at += len(data)
                return values[whole:]

            for batch in batches:
                doc_ids += batch.column(0).to_pylist()
                lengths += batch.column(1).to_pylist()
                for ids in batch.column(2).to_pylist():
                    pending.append(np.frombuffer(ids, "<u4"))
                    held += len(pending[-1])
                    if held >= block * CHUNK_BLOCKS:
                        rest = flush(np.concatenate(pending), False)
                        pending, held = [rest], len(rest)
            flush(np.concatenate(pending) if pending else np.zeros(0, np.uint32), True)
            out.write(_footer(doc_ids, lengths, np.array(starts, "<u8"), at))
        files.move(temporary, final)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([f"{folder}/part-{part:05d}.ids"]), pa.array([int(sum(lengths))], pa.int64()), pa.array([len(doc_ids)], pa.int64())],
            ["part", "path", "n_values", "n_documents"],
        )

    return run


def write_token_files(coded: DataFrame, folder: str, id_column: str = "doc_id", block: int = BLOCK, percentile: float = PERCENTILE, presorted: bool = False) -> DataFrame:
    """Writes the ids of coded (id_column, n_tokens, ids) into files under folder, in ascending
    id order (nulls last; equal ids by the sha256 of their ids, so that splitters stay small);
    returns one row per file: part, path, n_values, n_documents, stored. Partitions without rows
    write files without documents. An empty table gives files without documents. With
    ``presorted`` the rows are range-partitioned and sorted already, as by :func:`tokenize_to_files`."""
    rows = coded.select(F.col(f"`{id_column}`").cast("long").alias("id"), "n_tokens", "ids")
    if not presorted:
        order = [F.col("id").asc_nulls_last(), F.col("tie")]
        rows = rows.withColumn("tie", F.sha2("ids", 256)).repartitionByRange(*order).sortWithinPartitions(*order).select("id", "n_tokens", "ids")
    schema = "part int, path string, n_values long, n_documents long"
    return stored(rows.mapInArrow(_writer(folder, block, percentile), schema), "token-files")


def tokenize_to_files(docs: DataFrame, tokenizer_file: str, folder: str, text: str = "text", id_column: str = "doc_id", block: int = BLOCK, percentile: float = PERCENTILE) -> DataFrame:
    """Encodes the texts of docs (see :func:`encode_ids`) and writes their ids into files in
    ascending id order (nulls last; equal ids by the sha256 of their texts). Documents are
    range-partitioned and sorted before they are encoded, so Spark's sample of splitters reads ids
    and digests but never runs the tokenizer, and each task encodes and writes one sorted
    partition in one pass. Returns the rows of :func:`write_token_files`."""
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    rows = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.col(f"`{text}`").cast("string").alias("text"),
        F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256).alias("tie"),
    )
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return write_token_files(encode_ids(rows, tokenizer_file), folder, block=block, percentile=percentile, presorted=True)


def _reader(batches):
    for batch in batches:
        for path, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            files, inside = fs.FileSystem.from_uri(path)
            with files.open_input_file(inside) as handle:
                ids, valid, places, counts, crcs = document_digests(handle)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), mask=valid == 0), pa.array(places + offset, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document of the files, in the files' order: doc_id, start (ids of all documents before
    it), n_tokens and ids_crc32, read from the files alone. Offsets of files come from a window
    over the file rows, one per written partition; each file is read by its own task."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("part", "path", F.coalesce(F.sum("n_values").over(before), F.lit(0)).alias("offset"))
    spread = placed.repartitionByRange(max(files.count(), 1), "part").select("path", "offset")
    return spread.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = tokenize_to_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "token-ids"))
    return read_token_files(files)
