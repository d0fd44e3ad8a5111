"""The pipeline against plain loops over the same documents."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers

import corpus_pipeline
from textquarry.llm import bpe, decontaminate, simhash, toxicity
from textquarry.llm.common import table

from .test_decontaminate import brute_force
from .test_simhash import plain_classes


def test_stages(spark, write_tables, make_docs):
    rand = random.Random(21)
    words = ["".join(rand.choices("abcdefghij", k=rand.randrange(3, 8))) for _ in range(1500)]
    passage = lambda n: " ".join(rand.choices(words, k=n))
    items = [(k, f"{passage(20)}. {passage(6)}.") for k in range(12)]
    texts = [passage(rand.randrange(4, 150)) for _ in range(160)]
    for k in range(0, 160, 4):
        texts[k] += " villain scumbag villain"
    texts += [texts[5], texts[5].replace(" ", "\n", 3), texts[6] + " end", texts[7] + " x y", f"{passage(40)} {items[3][1]} {passage(9)}", items[4][1], "", None, " "]
    docs = make_docs([*enumerate(texts), (9, texts[9])])
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(160)], "doc_id long, quality int, toxic int")
    path = write_tables(documents=docs, labels=labels, benchmark=spark.createDataFrame(items, "item_id long, text string"))

    score = toxicity.train(table(spark, path, "documents"), table(spark, path, "labels")).scorer()
    kept = {k: t for k, t in enumerate(texts) if score(t) < toxicity.THRESHOLD}
    assert not any(k % 4 == 0 for k in kept if k < 160)
    groups = {}
    for k, t in kept.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), k)
    kept = {k: texts[k] for k in groups.values()}
    same = plain_classes({k: simhash.text_fingerprint(t) for k, t in kept.items()})
    kept = {k: t for k, t in kept.items() if same[k] == k}
    leaked = {k for k, _ in brute_force([(k, t or "") for k, t in kept.items()], items)}
    assert leaked == {164, 165}
    kept = {k: t for k, t in kept.items() if k not in leaked}

    encoding = bpe.make_encoding(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    want = set()
    for k, t in kept.items():
        ids = encoding.encode_ordinary(t or "")
        want.add((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    rows = corpus_pipeline.run(spark, path).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)

    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
    assert decontaminate.RANK == 128


def test_empty_tables(spark, write_tables, make_docs):
    path = write_tables(
        documents=make_docs([]),
        labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([], "item_id long, text string"),
    )
    assert corpus_pipeline.run(spark, path).count() == 0
