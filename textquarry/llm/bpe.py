"""Byte-level BPE: texts to token ids and back to bytes, by the tiktoken library and a rank file.

Long texts are cut before they reach the library, at places where no match of the splitting
pattern can reach across: before a blank or line feed that follows a character that is no white
space. Every token ends there anyway, so the ids are those of the whole text.

Long runs of white space are taken apart too: the library's regular expression runs out of
backtracking stack on runs of some million characters. By the pattern, a run that a non-blank
follows is one match of all but its last character, and a run at the end of the text one match
whole; such a match is coded as one piece, by the library's byte-pair merge without the
expression, which gives the ids that the library would give the match.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

#: Characters after which the next safe boundary is looked for.
PIECE_CHARACTERS = 50_000

_BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")

#: Runs of white space at least this long are coded apart (see above).
LONG_RUN = 4_096

# The characters of Unicode's White_Space property, which ``\s`` of the pattern
# matches (Python's own ``\s`` also takes U+001C to U+001F, which the pattern does not).
_WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_WHITE = re.compile(f"[{_WHITE_SPACE}]{{{LONG_RUN},}}")


def read_ranks(path: str) -> bytes:
    """A rank file as it is: lines of a token in base64 and its rank."""
    with open(path, "rb") as file:
        return file.read()


def make_encoding(ranks: bytes, pattern: str):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in pairs}, special_tokens={})


def safe_pieces(text: str, characters: int = PIECE_CHARACTERS) -> Iterator[str]:
    """The text in order, cut at safe boundaries after at least so many characters."""
    start = 0
    while len(text) - start > characters and (at := _BOUNDARY.search(text, start + characters)):
        yield text[start : at.start()]
        start = at.start()
    yield text[start:]


def runs_apart(text: str) -> Iterator[tuple[str, bool]]:
    """The text in order as (part, one match): long runs of white space are single matches."""
    start = 0
    for run in _LONG_WHITE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield text[start : run.start()], False
        yield text[run.start() : end], True
        start = end
    yield text[start:], False


def encode_text(encoding, text: str, characters: int = PIECE_CHARACTERS) -> np.ndarray:
    """Token ids (unsigned 32 bits) of a whole text; strings of special tokens are ordinary text."""
    parts = []
    for part, match in runs_apart(text):
        if match:
            parts.append(np.asarray(encoding._encode_single_piece(part), dtype="<u4"))
        elif part or not parts:
            parts += [encoding.encode_to_numpy(piece, disallowed_special=()) for piece in safe_pieces(part, characters)]
    return (parts[0] if len(parts) == 1 else np.concatenate(parts)).astype("<u4", copy=False)


def decode_ids(encoding, ids: np.ndarray) -> bytes:
    """The raw bytes of the ids; they need not be whole UTF-8 characters."""
    return encoding.decode_bytes(ids.tolist())


def _coder(ranks, pattern: str, characters: int) -> Callable:
    def run(batches):
        encoding = make_encoding(ranks.value, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                ids = [encode_text(encoding, text or "", characters) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([x.tobytes() for x in ids], pa.binary()),
                        pa.array([decode_ids(encoding, x) for x in ids], pa.binary()),
                    ],
                    ["row", "n_tokens", "ids", "decoded"],
                )

    return run


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), characters: int = PIECE_CHARACTERS) -> DataFrame:
    """One row per row of df: kept columns, n_tokens, ids (little-endian unsigned 32 bits), decoded bytes.

    A null text counts as empty: no tokens, empty bytes. Repeated rows are coded each; extra columns
    are ignored unless kept; an empty table gives an empty table. rank_file is read on the driver
    and sent to the tasks: its size is that of a vocabulary and does not grow with the data.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    rows = df.select(F.struct(*keep).alias("row"), F.col(text).cast("string").alias("text"))
    schema = rows.select("row", F.lit(0).cast("long").alias("n_tokens"), F.lit(b"").alias("ids"), F.lit(b"").alias("decoded")).schema
    coded = rows.mapInArrow(_coder(ranks, pattern, characters), schema)
    return coded.select("row.*", "n_tokens", "ids", "decoded")


def digests(coded: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return coded.select(*keep, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def token_digests(docs: DataFrame) -> DataFrame:
    """Digests of the ids and of the decoded bytes of each document."""
    import public_tokenizers

    return digests(encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
