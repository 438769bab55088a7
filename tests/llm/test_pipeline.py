from __future__ import annotations

from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as P
from caremeter.llm import order_minhash as O
from caremeter.llm.mixing import in_mix_order, mix

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        steps[name] = docs.collect()
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    start = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(steps["language_id"]) >= 0.99 * len(start)

    last = {}
    for r in steps["language_id"]:
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text)
        last[key] = max(last.get(key, -1), r.doc_id)
    assert sorted(r.doc_id for r in steps["exact_dedup"]) == sorted(last.values())

    texts = {r.doc_id: r.text for r in steps["exact_dedup"]}
    root = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if i < j and root[i] != root[j] and O.similar(texts[i], texts[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert sorted(r.doc_id for r in steps["near_dedup"]) == sorted(set(root.values()))

    assert {r.doc_id for r in steps["mixing"]} == {r.doc_id for r in steps["near_dedup"]}
    times = Counter(r.doc_id for r in steps["mixing"])
    ids = Counter()
    for r in steps["packing"]:
        ids[r.doc_id] += r.length
        assert r.length & (r.length - 1) == 0
    tokens = {r.doc_id: r.doc_tokens for r in steps["packing"]}
    assert ids == {i: n * tokens[i] for i, n in times.items()}


def test_run_is_the_stages(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "doc_tokens", "ids", "bucket", "sequence_id", "offset"] and out.count() > 0
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None


def test_stages_take_empty_tables(spark, docs):
    for name, stage in P.STAGES:
        assert stage(spark, docs([]), SF).count() == 0, name
    for name, stage in P.STAGES:
        assert stage(spark, docs([(None, None), (1, "the same of and"), (1, "the same of and")]), SF).count() >= 0, name


def test_sequences_follow_the_mix_after_a_reread(spark, docs, tmp_path):
    rows = [(i, "the same of and " * (1 + i * 37 % 900), None, f"s{i % 3}") for i in range(200)]
    mixed = in_mix_order(mix(docs(rows), block_docs=4))
    want = [(r.doc_id) for r in mixed.collect()]
    path = str(tmp_path / "mixed")
    mixed.select(*docs(rows).columns).write.parquet(path)
    assert len(list((tmp_path / "mixed").glob("part-*.parquet"))) > 2
    got = P.packed_sequences(spark, spark.read.parquet(path), SF).orderBy("sequence_id").collect()
    assert [r.doc_id for r in got if r.start == 0] == want
    assert len({r.sequence_id for r in got}) == len(got)
