from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from caremeter.llm import ann_graph as A


def brute(rows, asked, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, v in ok:
        if i in asked:
            hits = sorted((-(v @ w) / np.linalg.norm(v) / np.linalg.norm(w), j) for j, w in ok if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in hits[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")


def test_recall_and_exact_scores(vectors):
    index = A.build_index(vectors, shard_rows=100)
    asked = vectors.where("vec_id % 5 = 0")
    found = got(A.search(index, asked, block_rows=30))
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    wanted = brute(rows, {i for i, _ in rows if i % 5 == 0})
    assert set(found) == set(wanted)
    hits = [len({j for j, _ in found[q]} & {j for j, _ in wanted[q]}) / 5 for q in wanted]
    assert np.mean(hits) >= 0.95
    for q, own in found.items():
        scores = dict(wanted[q])
        assert all(s == pytest.approx(scores[j], abs=1e-14) for j, s in own if j in scores)
        assert [(-s, j) for j, s in own] == sorted((-s, j) for j, s in own)


def test_graph_in_numpy():
    rng = np.random.default_rng(1)
    points = A.unit(rng.normal(size=(700, 16)))
    edges, start = A.build_graph(points)
    assert edges.shape == (700, A.DEGREE) and (edges != np.arange(700)[:, None]).all()
    assert all(len(set(e[e >= 0])) == (e >= 0).sum() for e in edges)
    found, _, _ = A.beam_search(points, edges, points[:100], start, 48)
    true = np.argsort(-points[:100] @ points.T, axis=1)[:, :5]
    assert np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(found, true)]) > 0.95


def test_copies_ties_and_unusable_vectors(spark):
    same, other = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(i, same) for i in range(40)] + [(100 + i, [float(i), 1.0, 2.0]) for i in range(4)] + [
        (200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 2.0]), (203, [float("nan"), 1.0, 1.0]), (204, [float("inf"), 1.0, 1.0]),
        (None, same), (205, []), (206, [1.0, 2.0]), (207, [2.0, 4.0, 6.0]), (100, [0.0, 1.0, 2.0]), (208, other)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("ids", F.lit(1)).repartition(3)
    asked = {0, 30, 39, 100, 200, 201, 202, 203, 204, 206, 207, 208}
    found = got(A.search(A.build_index(df, shard_rows=20), df.where(F.col("vec_id").isin(*asked) | F.col("vec_id").isNull())))
    wanted = brute([r for n, r in enumerate(rows) if r[0] != 100 or n < 50], asked)
    assert {q: [j for j, _ in own] for q, own in found.items()} == {q: [j for j, _ in own] for q, own in wanted.items() if own}
    empty = df.where("vec_id < 0")
    assert A.search(A.build_index(empty), empty).count() == 0
