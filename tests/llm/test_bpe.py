import hashlib

import numpy as np
import public_tokenizers
import pytest

from textquarry.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    return bpe.make_encoding(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.mark.parametrize(
    "text",
    ["", " ", "a", "it's  we'll\n\n x1 2  \x1c \x1c y <|endoftext|>", "a  b\t\n c ", "あい \U0001f600́!?", "x" * 3000, " \n" * 500 + "z", "ab " * 700],
)
@pytest.mark.parametrize("characters", [1, 7, 50_000])
def test_pieces_have_the_ids_of_the_whole(encoding, text, characters):
    ids = bpe.encode_text(encoding, text, characters)
    assert ids.tolist() == encoding.encode_ordinary(text)
    assert "".join(bpe.safe_pieces(text, characters)) == text
    assert bpe.decode_ids(encoding, ids) == text.encode()


def test_documents(spark, encoding, make_docs):
    texts = [(1, "Hello world"), (2, None), (3, ""), (3, ""), (None, "un été"), (9, "long words " * 60_000)]
    rows = bpe.token_digests(make_docs(texts)).collect()
    assert len(rows) == len(texts)
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows}
    for k, t in texts:
        ids = encoding.encode_ordinary(t or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert (k, len(ids), digest, hashlib.sha256((t or "").encode()).hexdigest()) in found


def test_empty_table(make_docs):
    assert bpe.token_digests(make_docs([])).count() == 0


@pytest.mark.parametrize(
    "run",
    [" " * 2_000_000, "\n" * 2_000_000, " \n\t\r" * 500_000, "\n\n " * 666_667, "a" + " " * 2_000_000 + "b", "x \n" * 700_000],
)
def test_long_runs_of_white_space(encoding, run):
    """Ids equal a plain model of the pattern: every match of it, by the regex module, merged alone
    (the library's own expression runs out of stack on these)."""
    import time

    import regex

    start = time.perf_counter()
    got = bpe.encode_text(encoding, run, 1_000)
    assert time.perf_counter() - start < 30
    plain = [i for m in regex.finditer(public_tokenizers.PATTERN, run) for i in encoding._encode_single_piece(m.group())]
    assert got.tolist() == plain
    assert bpe.decode_ids(encoding, got) == run.encode()


@pytest.mark.parametrize("text", ["", "a", " " * 5000, "x" + " " * 5000, " " * 5000 + "y", "a \u3000" * 3000 + "\x1c" * 5000 + "b", "z" + "\n " * 3000 + "\t" * 4096 + "q"])
def test_runs_apart_keep_the_ids_of_the_library(encoding, text):
    assert bpe.encode_text(encoding, text).tolist() == encoding.encode_ordinary(text)
    assert "".join(part for part, _ in bpe.runs_apart(text)) == text
