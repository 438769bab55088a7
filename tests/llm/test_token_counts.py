from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from caremeter.llm import token_counts as T

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def whole():
    import sentencepiece
    encode = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode
    return lambda t: len(encode(t or ""))


def test_pre_tokens_sum_to_the_whole_text(whole):
    random.seed(3)
    counter, parts = T.PieceCounter(MODEL), [*" \n\t  ▁aeé日🙂.,'x0", "</s>", "<s>", "<unk>", "\0", "the", "   ", "▁▁"]
    for _ in range(5000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 25)))
        assert sum(counter.many(T.pre_tokens(text))) == whole(text), text


def test_counts_like_the_library(docs, sample, whole, monkeypatch):
    rows = [(1, None), (2, ""), (3, " "), (4, "a  b </s>"), (None, "no id"), (6, "twice"), (6, "twice"), (6, "other"),
            (-7, "negative id"), (8, "word " * 100_000), (2**60 + 1, "big id"), (9, "x" * 50_000), (10, "퟿\x00é")]
    out = T.count_tokens(docs(rows), MODEL)
    expected = sorted([(i, len((t or "").encode()), whole(t)) for i, t in rows], key=str)
    assert sorted([tuple(r) for r in out.collect()], key=str) == expected
    monkeypatch.setattr(T, "BLOCK_DOCS", 7)
    out = T.count_tokens(sample.withColumn("n", F.lit(1)).withColumn("bucket", F.lit(1)), MODEL, buckets=5)
    assert sorted(map(tuple, out.collect())) == sorted((r.doc_id, len(r.text.encode()), whole(r.text)) for r in sample.collect())


def test_empty_table(docs):
    assert T.count_tokens(docs([]), MODEL).count() == 0
