from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from caremeter.llm.exact_dedup import drop_copies, mark_copies

ROWS = [(1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, "other"), (5, None), (6, ""), (7, "É"), (8, "é"),
        (9, "x" * 200_000), (10, "X" * 200_000), (None, "other"), (4, "other"), (11, " same text")]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, keep=max):
    out = []
    for i, t in rows:
        own = [j for j, u in rows if lower(u) == lower(t)]
        best = keep([j for j in own if j is not None], default=None)
        out.append((i, best, len(own), i == best, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()], key=str)


def test_marks_like_brute_force(docs):
    df = docs(ROWS)
    assert got(mark_copies(df, keep="max")) == brute(ROWS)
    assert got(mark_copies(df.select("doc_id", "text"))) == brute(ROWS, min)


def test_collisions_are_taken_apart(docs):
    def weak(c):
        return F.substring(F.md5(c), 1, 1)
    assert got(mark_copies(docs(ROWS), keep="max", hash_of=weak)) == brute(ROWS)
    assert got(mark_copies(docs(ROWS).select("doc_id", "text"), keep="max", hash_of=weak)) == brute(ROWS)


def test_drop_leaves_one_row_of_each_text(docs):
    left = drop_copies(docs(ROWS), keep="max")
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 6, 7, 8, 10, 11]


def test_clashing_columns_and_empty_table(docs):
    df = docs(ROWS).withColumn("h", F.lit("mine")).withColumn("kept", F.lit(3)).withColumn("i", F.lit(1))
    out = mark_copies(df, keep="max")
    assert got(out) == brute(ROWS)
    assert {r.h for r in out.collect()} == {"mine"} and dict(out.dtypes)["kept"] == "boolean"
    assert mark_copies(docs([])).count() == 0 and drop_copies(docs([])).count() == 0


def test_no_python_in_the_plan(docs):
    plan = mark_copies(docs(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
