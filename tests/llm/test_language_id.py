from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caremeter.llm import language_id as L
from caremeter.llm.queries import held_out


JAPANESE = "すべての人間は生まれながらにして自由でありかつ尊厳と権利とについて平等である 人間は理性と良心とを授けられており互いに同胞の精神をもって行動しなければならない"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(corpus):
    return L.fit(corpus, where=~held_out(), per_lang=120)


def test_grams_by_hand():
    def plain(word):
        runs, total = L.RUN.findall(word.lower()), 0
        for r in runs:
            total += sum(max(0, len(r) + 2 - n + 1) for n in L.GRAMS)
        return total
    words = ["ab", "1", "x-y", "é", "", "Zürich,", "²", "日本", "a1b"]
    buckets, counts = L.gram_buckets(words)
    assert list(counts) == [plain(w) for w in words] and len(buckets) == counts.sum()
    one = L.gram_buckets(["abc"])[0]
    together, sizes = L.gram_buckets(["zz", "abc", "q"])
    assert sorted(one) == sorted(together[sizes[0]:sizes[0] + sizes[1]])       # a word's buckets do not depend on others


def test_words_sum_to_the_text(model):
    text = "The anand ofthe, Äußere 12 x"
    buckets, _ = L.gram_buckets([text])
    logits, grams = L.Scorer(model).logits([text])
    assert grams[0] == len(buckets)
    assert np.allclose(logits[0], model.embeddings[buckets].mean(axis=0) @ model.weights, atol=1e-4)


def test_held_out_accuracy(corpus, model):
    out = L.detect(corpus, model).where(held_out() & F.col("lang").isNotNull()).select("lang", "lang_pred", "score", "rejected").toPandas()
    assert len(out) > 200 and (out["lang"] == out["lang_pred"]).mean() > 0.98
    assert out["score"].between(0, 1).all() and out["rejected"].mean() < 0.01


def test_learning_never_sees_held_out(corpus):
    sample = L.learning_sample(corpus.where(~held_out()), F.col("text"), F.col("lang"), F.col("doc_id"), 50, 100, 1000)
    assert all(zlib.crc32(str(k).encode()) % 4 != 2 for k in sample["k"])
    assert sample["t"].str.len().max() <= 100 and sample["y"].value_counts().max() < 100
    again = L.learning_sample(corpus.where(~held_out()).repartition(7), F.col("text"), F.col("lang"), F.col("doc_id"), 50, 100, 1000)
    assert sample.equals(again)


def test_edges_and_clashes(docs, model):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "²²"), (5, JAPANESE), (None, "the and of"), (6, "the " * 200_000),
            (7, "the and of"), (7, "the and of")]
    df = docs(rows).withColumn("found", F.lit(1)).withColumn("score", F.lit("old"))
    out = {(r.doc_id, (r.text or "")[:3]): r for r in L.detect(df, model).collect()}
    assert {out[k].lang_pred for k in ((1, ""), (2, ""), (3, "123"), (4, "²²"))} == {"und"}
    assert all(out[k].score == 0 and out[k].rejected for k in ((1, ""), (2, "")))
    assert out[5, JAPANESE[:3]].lang_pred in model.langs and out[5, JAPANESE[:3]].rejected
    assert out[6, "the"].lang_pred == out[7, "the"].lang_pred == out[None, "the"].lang_pred == "en"
    assert L.detect(df, model).count() == len(rows) and L.detect(docs([]), model).count() == 0
    nothing = L.fit(docs(rows))
    assert nothing.langs == [L.NONE] and L.detect(df, nothing).count() == len(rows)
