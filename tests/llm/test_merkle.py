from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from caremeter.llm import queries as Q
from caremeter.llm.merkle import build, digest, fold, proof, prove, verify

ROWS = [(i, f"Text {i}", "en" if i % 3 else "fr", f"src{i % 4}", i) for i in range(75)]
ROWS += [(100, "Alone", "zz"), (101, None, None), (102, "", None, "", 0), (102, "", None, "", 0), (None, "A", "en"),
         (5, "again", "en"), (5, "Again", "en"), (103, "x" * 300_000, "é", "s"), (104, "-", "-"), (105, "a:b", "")]


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(t):
    return t if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def climb(nodes):
    """Root of a list of digests, and for each the (before, after) of its run at every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a - a % 8: a - a % 8 + 8]
            paths[i].append((run[:a % 8], run[a % 8 + 1:]))
            at[i] = a // 8
        nodes = [H("".join(nodes[j:j + 8])) for j in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for doc_id, text, lang, source, n in rows:
        leaf = H("".join(map(framed, (doc_id, source, lang, n, text))))
        cut = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        claimed = H("".join(map(framed, (doc_id, source, lang, n, lower(text))))) if cut else leaf
        groups.setdefault(lang, []).append((doc_id, leaf, claimed))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        made[g] = climb([r[1] for r in groups[g]])
    root, tops = climb([made[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for (doc_id, leaf, claimed), path in zip(groups[g], made[g][1]):
            own, siblings = claimed, []
            for before, after in path + tops[k]:
                siblings += before + after
                own = H("".join([*before, own, *after]))
            out.append((doc_id, leaf, made[g][0], root, H("".join(siblings)), own, own == root))
    return sorted(out, key=str)


def full(rows):
    return [(*r, *(None,) * (5 - len(r))) for r in rows]


def write(docs, tmp_path, rows):
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_query_like_brute_force(spark, docs, tmp_path):
    out = Q.QUERIES["op13_merkle_manifest"](spark, write(docs, tmp_path, ROWS))
    assert got(out) == brute(full(ROWS))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_sample_like_brute_force(spark, sample):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in sample.collect()]
    out = Q.QUERIES["op13_merkle_manifest"](spark, "/root/testdata/sf0.001")
    assert got(out) == brute(rows)
    assert 0 < sum(not r.verified for r in out.collect()) < len(rows)


@pytest.mark.parametrize("rows", [[], [(1, "only", "en")], [(1, None), (1, None)]])
def test_tiny_tables(spark, docs, tmp_path, rows):
    out = Q.QUERIES["op13_merkle_manifest"](spark, write(docs, tmp_path, rows))
    assert got(out) == (brute(full(rows)) if rows else [])


def test_other_columns_and_names(spark, docs):
    """Helper names may be the user's; a column that is not listed does not change the root, a listed one does."""
    df = docs(ROWS).withColumn("g", F.col("doc_id")).withColumn("h", F.lit("mine")).withColumn("idx", F.col("lang"))
    plain = build(df, ["doc_id", "text"]).root
    assert plain == build(df.withColumn("h", F.lit("other")), ["doc_id", "text"]).root
    other = build(df, ["doc_id", "text", "h"], carry={"h": F.col("h"), "idx": F.col("idx")})
    assert other.root != plain
    rows = prove(spark, other)
    assert {"key", "h", "leaf", "subroot", "root"} <= set(rows.columns)
    assert {r.h for r in rows.select("h").collect()} == {"mine"}
    with pytest.raises(ValueError):
        build(df, ["doc_id"], carry={"path": F.col("idx")})


def test_verify_accepts_only_the_row_itself(spark, docs):
    made = build(docs(ROWS), ["doc_id", "text"], carry={"text": F.col("text")})
    rows = prove(spark, made).where("key is not null")
    claims = rows.withColumn("same", verify(rows, digest(F.col("key"), F.col("text"))))
    claims = claims.withColumn("forged", verify(rows, digest(F.col("key"), F.concat(F.coalesce("text", F.lit("")), F.lit("!")))))
    assert {(r.same, r.forged) for r in claims.select("same", "forged").collect()} == {(True, False)}
    assert rows.select(proof(F.col("path"))).distinct().count() > 60
    assert {r[0] for r in rows.select(fold(F.col("leaf"), F.col("path"))).collect()} == {made.root}
