"""Approximate nearest neighbours by cosine on robust-pruned directed graphs, one graph per shard.

A point's neighbours are found by a greedy search of the graph as it stands; relaxed distance pruning then keeps an edge
only if no kept neighbour is clearly nearer to its end than the point itself, which leaves few and diverse edges. A
query walks every shard's graph with a beam, and the shards' findings are scored again in double precision and merged.

Equal vectors are one node of the graph, so thousands of copies of a vector cannot crowd out its other neighbours; the
node knows the smallest ids, and as ties go to smaller ids no others can be in a result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from caremeter.llm.common import saved

DEGREE, BUILD_BEAM, RELAX = 24, 48, 1.2
EXPAND = 4               # nodes of a beam that are expanded at a time
BATCH = 256              # points or queries that search together
FAR = np.float32(9.0)    # further than any two unit vectors

INDEX = "dim int, shard int, vectors binary, ids binary, edges binary"
FOUND = "query_id long, vec_id long, score double"


def beam_search(points: np.ndarray, edges: np.ndarray, queries: np.ndarray, start: int, beam: int):
    """Ids and squared distances of the ``beam`` nearest points met by each query (-1 fills up), and all ids expanded."""
    rows = np.arange(len(queries))
    ids = np.full((len(queries), beam), -1, np.int32)
    far = np.full((len(queries), beam), FAR, np.float32)
    done = np.zeros((len(queries), beam), bool)
    seen = np.zeros((len(queries), len(points)), bool)
    ids[:, 0], far[:, 0] = start, 2 - 2 * queries @ points[start]
    seen[:, start] = True
    expanded = []
    while True:
        order = np.argsort(np.where(done | (ids < 0), FAR, far), axis=1, kind="stable")[:, :EXPAND]
        pick = np.take_along_axis(ids, order, 1)
        fresh = (pick >= 0) & ~np.take_along_axis(done, order, 1)
        if not fresh.any():
            break
        np.put_along_axis(done, order, True, 1)
        pick = np.where(fresh, pick, -1)
        expanded.append(pick)
        near = np.where(fresh[:, :, None], edges[pick], -1).reshape(len(rows), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[np.take_along_axis(seen, np.maximum(near, 0), 1)] = -1
        hit = near >= 0
        width = int(hit.sum(axis=1).max())
        if not width:
            continue
        front = np.argsort(~hit, axis=1, kind="stable")[:, :width]
        near, hit = np.take_along_axis(near, front, 1), np.take_along_axis(hit, front, 1)
        r, c = np.nonzero(hit)
        seen[r, near[r, c]] = True
        gap = np.full(near.shape, FAR, np.float32)
        gap[r, c] = 2 - 2 * np.einsum("ij,ij->i", points[near[r, c]], queries[r])
        ids, far = np.hstack([ids, near]), np.hstack([far, gap])
        done = np.hstack([done, ~hit])
        best = np.argsort(far, axis=1, kind="stable")[:, :beam]
        ids, far, done = (np.take_along_axis(x, best, 1) for x in (ids, far, done))
    return ids, far, np.hstack(expanded)


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each point in ``own`` among its row of ``candidates`` (-1: none)."""
    cands = np.sort(np.where(candidates == own[:, None], -1, candidates), axis=1)
    cands[:, 1:][cands[:, 1:] == cands[:, :-1]] = -1
    ends = points[np.maximum(cands, 0)]
    gap = 2 - 2 * np.einsum("ijk,ik->ij", ends, points[own])
    gap[cands < 0] = FAR
    alive = cands >= 0
    out = np.full((len(own), degree), -1, np.int32)
    rows = np.arange(len(own))
    for slot in range(degree):
        pick = np.where(alive, gap, FAR * 2).argmin(axis=1)
        has = alive[rows, pick]
        if not has.any():
            break
        out[has, slot] = cands[rows, pick][has]
        between = 2 - 2 * np.einsum("ijk,ik->ij", ends, ends[rows, pick])
        alive &= ~((relax * relax * between <= gap) & has[:, None])
        alive[rows, pick] = False
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, seed: int = 5) -> tuple[np.ndarray, int]:
    """Edges (points x degree, -1 fills up) and the point to start from; ``points`` are distinct unit vectors."""
    n = len(points)
    rng = np.random.default_rng(seed)
    start = int((points @ points.mean(axis=0)).argmax())
    if n <= degree + 1:
        every = np.tile(np.arange(n, dtype=np.int32), (n, 1))
        every[np.arange(n), np.arange(n)] = -1
        return np.hstack([every, np.full((n, max(0, degree - n)), -1, np.int32)])[:, :max(degree, n)], start
    edges = np.full((n, degree), -1, np.int32)
    edges[:, :degree // 2] = rng.integers(0, n, (n, degree // 2))
    for strict in (1.0, relax):
        for own in np.array_split(rng.permutation(n), -(-n // BATCH)):
            ids, _, expanded = beam_search(points, edges, points[own], start, beam)
            edges[own] = robust_prune(points, own, np.hstack([ids, expanded, edges[own]]), degree, strict)
            _add_back(points, edges, own, strict)
    return edges, start


def _add_back(points: np.ndarray, edges: np.ndarray, own: np.ndarray, relax: float) -> None:
    """Edges from the new neighbours of ``own`` back to them; a full neighbour is pruned again."""
    to, origin = edges[own].ravel(), np.repeat(own, edges.shape[1])
    to, origin = to[to >= 0], origin[to >= 0]
    order = np.argsort(to, kind="stable")
    to, origin = to[order], origin[order]
    ends, first, count = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(first, count)
    for a in range(0, len(ends), BATCH):
        part = slice(a, a + BATCH)
        inside = slice(first[part][0], first[part][-1] + count[part][-1])
        coming = np.full((len(ends[part]), count[part].max()), -1, np.int32)
        coming[np.repeat(np.arange(len(ends[part])), count[part]), place[inside]] = origin[inside]
        edges[ends[part]] = robust_prune(points, ends[part], np.hstack([edges[ends[part]], coming]), edges.shape[1], relax)


def unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def _index(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.array(pdf["v"].tolist(), np.float64)
        edges, start = build_graph(unit(vectors))
        # the start goes first, so the edges need no number beside them
        order = np.concatenate([[start], np.delete(np.arange(len(vectors)), start)])
        new = np.empty(len(vectors), np.int32)
        new[order] = np.arange(len(vectors))
        edges = np.where(edges[order] >= 0, new[np.maximum(edges[order], 0)], -1).astype(np.int32)
        ids = np.full((len(vectors), k + 1), -1, np.int64)
        known = np.zeros((len(vectors), 1), np.int64)
        for row, at in enumerate(order):
            own = pdf["ids"].iloc[at]
            ids[row, :len(own)], known[row] = own, len(own)
        return pd.DataFrame([(pdf["dim"].iloc[0], pdf["shard"].iloc[0], vectors[order].tobytes(), np.hstack([known, ids]).tobytes(),
                              edges.tobytes())], columns=["dim", "shard", "vectors", "ids", "edges"])
    return run


def _search(k: int, beam: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(queries):
            row = index.iloc[0]
            vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
            table = np.frombuffer(row["ids"], np.int64).reshape(len(vectors), k + 2)
            edges = np.frombuffer(row["edges"], np.int32).reshape(len(vectors), -1)
            points, norms = unit(vectors), np.linalg.norm(vectors, axis=1)
            asked, own = np.array(queries["v"].tolist(), np.float64), queries["query_id"].to_numpy()
            for a in range(0, len(own), BATCH):
                part = asked[a:a + BATCH]
                found, _, _ = beam_search(points, edges, unit(part), 0, beam)
                for q, nodes in zip(range(a, a + len(part)), found):
                    nodes = nodes[nodes >= 0]
                    score = vectors[nodes] @ asked[q] / (norms[nodes] * np.linalg.norm(asked[q]))
                    hits = [(-s, int(i)) for s, t in zip(score, table[nodes]) for i in t[1:1 + t[0]] if i != own[q]]
                    out += [(own[q], i, -s) for s, i in sorted(hits)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    return run


def usable(vector: Column) -> Column:
    """Not NULL, not empty, every component finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def build_index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, shard_rows: int = 4_096) -> DataFrame:
    """One row per shard with its vectors, ids and edges: a written table. Every usable vector is in it."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    # the planner keeps k + 1 rows of a vector in every task before the shuffle, so copies do not meet in one task
    smallest = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    nodes = saved(smallest.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    shards = max(1, -(-nodes.count() // shard_rows))
    # vectors of another length are never compared: each length has shards of its own
    dealt = nodes.select("v", "ids", F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"))
    return saved(dealt.groupBy("dim", "shard").applyInPandas(_index(k), INDEX), "graphs")


def search(index: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
           beam: int = 96, block_rows: int = 2_048) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each usable query, not counting its own id.

    ``k`` is that of the index. Score is the cosine of the original vectors in double precision; ties go to the smaller
    id. Rows with a NULL id or with a NULL, zero or non-finite vector ask nothing; of rows with one id and different
    vectors each asks, and the best findings are returned together. Queries meet each shard in blocks of about
    ``block_rows``.
    """
    v = F.col(vector_col).cast("array<double>")
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), v.alias("v")).where(
        usable(F.col("v")) & F.col("query_id").isNotNull()).distinct()
    blocks = max(1, -(-asked.count() // block_rows))
    shards = index.select((F.col("dim") + 0).alias("dim"), (F.col("shard") + 0).alias("shard"))
    spread = asked.select("query_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    per_shard = spread.join(shards, "dim")
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = graphs.groupBy("dim", "shard", "block").cogroup(per_shard.groupBy("dim", "shard", "block")).applyInPandas(_search(k, beam), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    unique = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = unique.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
