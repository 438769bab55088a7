from __future__ import annotations

from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from caremeter.llm.mixing import in_mix_order, mix, period_schedule, shares


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=2), st.floats(0.001, 1000), min_size=1, max_size=25))
def test_less_than_one_block_off_at_any_time(weights):
    slots = shares(weights)
    period, placed = sum(slots.values()), Counter()
    for t, (source, block, slot) in enumerate(period_schedule(slots), 1):
        assert slot == t - 1 and block == placed[source]
        placed[source] += 1
        for s, w in slots.items():
            assert abs(placed[s] - Fraction(w * t, period)) < 1
    assert dict(placed) == slots


def test_shares_follow_weights():
    assert shares({"a": 3, "b": 1}) == {"a": 768, "b": 256}
    assert sum(shares({str(i): 1.0 + i for i in range(3000)}).values()) == 1 << 16
    for bad in (0, -1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            shares({"a": bad})


def rows_of(spec):
    return [(n * 1000 + i, "t", None, s) for n, (s, k) in enumerate(spec) for i in range(k)]


def check(out, rows, block_docs, weights=None):
    got = out.collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}                   # nobody is left out
    per_slot = defaultdict(list)
    for r in got:
        per_slot[r.mix_slot].append(r)
    sizes = Counter(r[3] for r in rows)
    for slot, own in per_slot.items():
        source, block = own[0].source, own[0].mix_block
        assert {(r.source, r.mix_block, r.mix_epoch) for r in own} == {(source, block, own[0].mix_epoch)}
        assert sorted(r.mix_position for r in own) == list(range(min(block_docs, sizes[source] - block * block_docs)))
    for epoch in {r.mix_epoch for r in got}:
        once = Counter(r.doc_id for r in got if r.mix_epoch == epoch)
        assert set(once.values()) == {1}
    return per_slot


def test_every_document_and_exact_blocks(docs):
    rows = rows_of([("a", 130), ("b", 40), (None, 25), ("c", 1)])
    slots = check(mix(docs(rows), block_docs=8, slice_docs=20, max_epochs=None), rows, 8)
    assert sorted(slots) == list(range(len(slots)))
    order = {"a": 4, "b": 2, None: 1, "c": 1}
    per_slot = check(mix(docs(rows), order, block_docs=8, slice_docs=20, max_epochs=None), rows, 8)
    placed = Counter()
    for t, slot in enumerate(sorted(per_slot), 1):
        placed[per_slot[slot][0].source] += 1
        for s, w in order.items():
            assert abs(placed[s] - w / 8 * t) < 1.01                          # shares are multiples of 1/1024
    with pytest.raises(KeyError):
        mix(docs(rows), {"a": 1})


def test_same_result_for_any_partitioning(docs):
    rows = rows_of([("a", 50), ("b", 20)])
    names = ("doc_id", "mix_slot", "mix_position", "mix_epoch")
    first, second = (sorted(map(tuple, mix(docs(rows, n), block_docs=4, slice_docs=7).select(*names).collect())) for n in (1, 5))
    assert first == second


def test_order_edges_and_clashes(docs):
    rows = rows_of([("a", 30), ("b", 9)]) + [(None, "x", None, "a"), (0, "t", None, "a"), (0, "t", None, "a")]
    df = docs(rows).withColumn("s", F.lit("mine")).withColumn("mix_slot", F.lit("old")).withColumn("source_key", F.lit(1))
    out = mix(df, block_docs=4)
    assert out.count() >= len(rows) and {"s", "source_key"} <= set(out.columns) and dict(out.dtypes)["mix_slot"] == "bigint"
    assert out.where("mix_epoch = 0").count() == len(rows)
    assert {r.s for r in out.collect()} == {"mine"} and {r.source_key for r in out.collect()} == {1}
    laid = [r.mix_slot for r in in_mix_order(out).collect()]
    assert laid == sorted(laid)
    assert mix(docs([])).count() == 0


def test_columns_named_like_helpers_keep_their_values(docs):
    names = ["s", "n", "w", "e", "t", "j", "nr", "row", "source_key", "slice", "place", "part", "epoch", "nth", "start", "__n", "__nth", "__epoch", "a.b"]
    df = docs(rows_of([("a", 30), ("b", 9)]))
    for name in names:
        df = df.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    out = mix(df, block_docs=4)
    assert out.columns == [*df.columns, "mix_slot", "mix_position", "mix_block", "mix_epoch"]
    for r in out.collect():
        assert all(r[name] == f"{name}{r.doc_id}" for name in names)
    plain = mix(docs(rows_of([("a", 30), ("b", 9)])), block_docs=4)
    keys = ("doc_id", "mix_slot", "mix_position", "mix_block", "mix_epoch")
    assert sorted(map(tuple, out.select(*keys).collect())) == sorted(map(tuple, plain.select(*keys).collect()))
