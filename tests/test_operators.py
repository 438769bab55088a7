"""Operators against brute force on small inputs, with hot keys, copies and NULL groups."""

from __future__ import annotations

import random
from collections import Counter
from decimal import Decimal, ROUND_HALF_UP
from fractions import Fraction

from pyspark.sql import functions as F

from caremeter.operators import checks as C, profiles as P
from caremeter.operators.compare import quadrants
from caremeter.operators.duplicates import check_duplicates, list_duplicates
from caremeter.operators.ordered import distribution, peer_rank, percentiles, ranked_values, sort_rows, top_k
from caremeter.operators.peers import gap_to_best, vs_benchmark


def sample_values(seed=5, n=900):
    """A third of the rows in one group; repeats, negatives, zero, large and NULL values; a NULL group."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        v = rng.choice([None, Decimal(rng.randint(-50, 50)), Decimal(rng.randint(0, 10 ** 8)) / 100, Decimal(rng.randint(0, 9999)) / 1000, Decimal(7)])
        rows.append((g, v))
    return rows


def by_group(rows):
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(Fraction(v))
    return {g: sorted(vs) for g, vs in groups.items()}


def half_up(x: Fraction, digits: int) -> Decimal:
    exact = Decimal(x.numerator) / Decimal(x.denominator)
    return exact.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)


def percentile(vs, p):
    pos = Fraction(str(p)) * (len(vs) - 1)
    low = int(pos)
    high = min(low + 1, len(vs) - 1)
    return vs[low] + (vs[high] - vs[low]) * (pos - low)


def test_ranked_values_and_percentiles(spark):
    rows = sample_values()
    df = spark.createDataFrame(rows, "g string, v decimal(18,6)")
    groups = by_group(rows)
    for r in ranked_values(df, ["g"], "v").collect():
        vs = groups[r.g]
        assert (r.n, r.n_below, r.n_group) == (vs.count(r.v), sum(x < r.v for x in vs), len(vs))
    ps = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p90": 0.9, "all": 1.0}
    got = {r.g: r for r in distribution(df, ["g"], "v", ps, 4).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].n == len(vs) and got[g].avg_val == half_up(sum(vs) / len(vs), 4)
        assert (got[g].min_val, got[g].max_val) == (half_up(vs[0], 4), half_up(vs[-1], 4))
        for name, p in ps.items():
            assert got[g][name] == half_up(percentile(vs, p), 4), (g, name)
    whole = percentiles(df, [], "v", {"m": 0.5}, 4).collect()
    assert [r.m for r in whole] == [half_up(percentile(sorted(x for vs in groups.values() for x in vs), 0.5), 4)]
    assert percentiles(df.where("false"), [], "v", {"m": 0.5}).first().m is None


def test_peer_rank(spark):
    rows = sample_values(seed=9)
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "i int, g string, v decimal(18,6)")
    groups = by_group(rows)
    ranked = peer_rank(df, "v", ["g"]).collect()
    assert len(ranked) == sum(map(len, groups.values()))
    for r in ranked:
        assert r.rank == 1 + sum(x > r.v for x in groups[r.g]) and r.total_peers == len(groups[r.g])
    overall = [x for vs in groups.values() for x in vs]
    for r in peer_rank(df, "v").collect():
        assert r.rank == 1 + sum(x > r.v for x in overall) and r.total_peers == len(overall)


def test_list_duplicates(spark):
    rng = random.Random(3)
    rows = [("hot", "m", None if i % 7 == 0 else f"d{i % 4}", f"x{i % 11}") for i in range(300)]
    rows += [("copies", "m", "d1", "same")] * 250
    rows += [(f"k{i}", rng.choice("mn"), "d1", str(i)) for i in range(200)]
    rows += [(None, "m", "d1", "1"), (None, "m", "d2", "2")]
    df = spark.createDataFrame(rows, "k string, m string, d string, x string")
    for slice_rows in (1, 40, 10 ** 6):   # digest prefixes of several lengths, of one, none
        check_listed(rows, list_duplicates(df, ["k", "m"], "d", slice_rows=slice_rows, chunk=40).collect())
    repeated = {k for k, n in Counter((k, m) for k, m, *_ in rows).items() if n > 1}
    assert check_duplicates(df, "t", ["k", "m"]).first().duplicate_keys == len(repeated)


def test_list_duplicates_shuffles_rows_once(spark):
    df = spark.range(2000).selectExpr("CAST(id % 500 AS STRING) AS k", "CAST(id AS STRING) AS d", "repeat(CAST(id AS STRING), 9) AS x")
    found = list_duplicates(df, ["k"], "d")
    assert len(found.collect()) == 1500
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning(") == 1          # no key is large, so neither the counts nor their join stay


def check_listed(rows, got):
    sizes = Counter((k, m) for k, m, *_ in rows)
    by_key = {}
    for r in got:
        by_key.setdefault((r.k, r.m), []).append(r)
    assert set(by_key) == {k for k, n in sizes.items() if n > 1}
    for key, listed in by_key.items():
        assert sorted(r.ranking for r in listed) == list(range(2, sizes[key] + 1))
        listed.sort(key=lambda r: r.ranking)
        dates = [(r.d is None, r.d) for r in listed]
        assert dates == sorted(dates)
        everything = Counter((d, x) for k, m, d, x in rows if (k, m) == key)
        rest = everything - Counter((r.d, r.x) for r in listed)
        assert sum(rest.values()) == 1   # exactly the first row of the key is left out


def test_join_counts_without_pairs(spark):
    left = [("hot",)] * 400 + [("a",)] * 3 + [("only_left",), (None,)]
    right = [("hot",)] * 300 + [("a",)] * 2 + [("only_right",), (None,)]
    a, b = (spark.createDataFrame(x, "k string") for x in (left, right))
    assert C.join_size(a, b, "k", "test").first().matched_rows == 400 * 300 + 6
    bronze = spark.createDataFrame(
        [(" a ", "m", "x"), ("a", "m", "N/A"), ("a", "m", " "), ("b", "m", "5"), ("c", "m", "odd")], "facility_id string, measure_id string, score string")
    silver = spark.createDataFrame(
        [("a", "m", None), ("a", "m", None), ("b", "m", 5.0), ("c", "m", None)], "facility_id string, measure_id string, score double")
    assert C.check_lost_values(bronze, silver, "t", ["facility_id", "measure_id"], "score", ["score"]).first().lost_scores == 3


def test_reconciliation_checks(spark):
    bronze = spark.createDataFrame([("a",), ("b",)], "k string")
    silver = spark.createDataFrame([("a",)], "k string")
    assert C.check_counts({"t": bronze}, {"t": silver}).first()[1:] == (2, 1, False)
    assert C.check_orphans(bronze, silver, "t", "k").first().orphan_ids == 1
    spots = C.spot_check(spark.createDataFrame([(" a", "1"), ("a", "1"), ("b", "2")], "k string, raw string"),
                         spark.createDataFrame([("a", 1), ("b", 2)], "k string, typed int"),
                         ["k"], "k", ["a"], {"raw": "bronze_raw"}, {"typed": "silver_typed"}).collect()
    assert [tuple(r) for r in spots] == [("a", "1", 1, 2)]
    flags = spark.createDataFrame([("a", True), ("a", False), ("b", False), ("c", None)], "k string, f boolean")
    assert {r.k for r in C.never_true(flags, "k", "f").collect()} == {"b", "c"}


def test_three_valued_filters(spark):
    """``<>`` drops NULL as well: a NULL owner is not kept by 'not Tribal'."""
    df = spark.createDataFrame([("Tribal",), (None,), ("Government",)], "o string")
    assert [r.o for r in df.where(F.col("o") != "Tribal").collect()] == ["Government"]


def test_shares_and_overlap(spark):
    df = spark.createDataFrame([("a", "x")] * 2 + [("a", "y")] + [("b", "x")], "g string, v string")
    within = {(r.g, r.v): (r.n, r.pct) for r in P.share_within(df, ["g", "v"], ["g"]).collect()}
    assert within == {("a", "x"): (2, Decimal("66.67")), ("a", "y"): (1, Decimal("33.33")), ("b", "x"): (1, Decimal("100.00"))}
    overall = {r.v: r.pct for r in P.share_within(df, ["v"]).collect()}
    assert overall == {"x": Decimal("75.00"), "y": Decimal("25.00")}
    sets = {n: spark.createDataFrame([(k,) for k in ks], "k string") for n, ks in {"p": "aab", "q": "bc"}.items()}
    assert {r.k: (r.p, r.q) for r in P.overlap(sets, "k").collect()} == {"a": (True, False), "b": (True, True), "c": (False, True)}


def test_profiles(spark):
    df = spark.createDataFrame([("1",), ("2.5",), ("",), (None,), ("Not Available",), ("odd",), ("odd",)], "s string")
    assert tuple(P.profile_missing(df, ["s"]).first()) == ("s", 7, 2, 2, 1)
    assert {(r.s, r.n) for r in P.profile_odd_values(df, "s").collect()} == {("odd", 2)}
    assert {r.facility: r.n_per_id for r in P.odd_group_sizes(
        spark.createDataFrame([("a",)] * 3 + [("b",)] * 2, "facility string"), "facility", 2).collect()} == {"a": 3}


def test_inventory_variants(spark):
    df = spark.createDataFrame([("m", True, Decimal(1)), ("m", False, Decimal(9)), ("m", False, None), ("n", False, None)],
                               "measure_id string, is_score_usable boolean, score decimal(18,6)")
    get = lambda **k: {r.measure_id: r for r in P.inventory(df, ["measure_id"], "score", **k).collect()}
    assert get()["m"].pct_usable == Decimal("33.33") and get()["m"].avg_score == Decimal("5.00")
    assert get(whole_pct=True)["m"].pct_usable == Decimal("33.00")
    assert get(avg_usable_only=True)["m"].avg_score == Decimal("1.00")
    assert get(usable_rows_only=True)["m"].pct_usable == Decimal("100.00")
    assert set(get(keep_empty=False)) == {"m"}


def test_sort_rows_places_nulls(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", None), ("a", 3)], "k string, v int")
    assert [tuple(r) for r in sort_rows(df, "k", "-v").collect()] == [("a", None), ("a", 3), ("b", 1), (None, 2)]


def test_top_k_with_ties(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(10)], "id int, v int")
    assert [r.id for r in top_k(df, [F.desc("v")], 3, ["id"]).collect()] == [1, 3, 5]


def test_quadrants(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, None)], "x int, y int")
    got = {(r.x_half, r.y_half): r.n for r in quadrants(df, "x", "y").collect()}
    assert got == {("low", "low"): 2, ("high", "high"): 1}


def test_quadrants_of_tiny_differences(spark):
    """Halves come from ranks: medians far below six digits, even counts, ties at the median and copies."""
    for xs in (["0.0000001", "0.0000002", "0.0000003"], ["1", "2", "2", "3"], ["1", "1", "1", "2"], ["1", "2", "3", "4"],
               ["0.000000000001", "0.000000000002"], ["5"]):
        xs = [Decimal(x) for x in xs]
        df = spark.createDataFrame([(x, -x) for x in xs], "x decimal(38,12), y decimal(38,12)")
        middle = percentile(sorted(Fraction(x) for x in xs), 0.5)
        want = Counter(("high" if x > middle else "low", "high" if -x > -middle else "low") for x in xs)
        got = quadrants(df, "x", "y").collect()
        assert {(r.x_half, r.y_half): r.n for r in got} == want
        for r in got:
            inside = [x for x in xs if ("high" if x > middle else "low") == r.x_half and ("high" if -x > -middle else "low") == r.y_half]
            assert r.avg_x == half_up(Fraction(sum(inside)) / len(inside), 2)
    assert quadrants(df.where("false"), "x", "y").collect() == []


def peers_data(spark):
    dim = spark.createDataFrame([("a", "PA", "N", "T", 3), ("b", "PA", "N", "T", 5), ("c", "PA", "N", "T", 5), ("d", "NY", "N", "T", 5)],
                                "facility_id string, state string, hospital_ownership string, hospital_type string, hospital_overall_rating int")
    fact = spark.createDataFrame([("a", "m", Decimal(9), True), ("b", "m", Decimal(4), True), ("b", "m", Decimal(5), True),
                                  ("c", "m", Decimal(3), False), ("d", "m", Decimal(1), True), ("a", "other", Decimal(1), True)],
                                 "facility_id string, measure_id string, score decimal(18,6), is_score_usable boolean")
    return dim, fact


def test_vs_benchmark(spark):
    dim, fact = peers_data(spark)
    rows = vs_benchmark(fact, dim, "score", ["m"], ("own", "peer", "diff"), digits=2, entity="a").collect()
    assert [(r.facility_id, float(r.own), float(r.peer), float(r.diff)) for r in rows] == [("a", 9.0, 6.0, 3.0)]
    assert vs_benchmark(fact, dim, "score", ["m"], ("own", "peer", "diff")).count() == 4


def test_gap_to_best(spark):
    dim, fact = peers_data(spark)
    rows = gap_to_best({"t": fact}, dim, {"t": ("m",)}, F.col("hospital_overall_rating") == 5, entity="a").collect()
    assert [(float(r.own_score), float(r.best_peer_avg), float(r.gap_to_close)) for r in rows] == [(9.0, 4.5, 4.5)]
    everyone = gap_to_best({"t": fact}, dim, {"t": ("m",)}, F.col("hospital_overall_rating") == 5).collect()
    assert {r.facility_id for r in everyone} == {"a", "b", "c", "d"}   # own rows count, usable or not


def test_gap_keeps_a_measure_whose_peers_have_no_number(spark):
    dim, fact = peers_data(spark)
    more = spark.createDataFrame([("a", "text", Decimal(5), True), ("b", "text", None, True)], fact.schema)
    rows = gap_to_best({"t": fact.union(more)}, dim, {"t": ("text",)}, F.col("hospital_overall_rating") == 5, entity="a").collect()
    assert [(float(r.own_score), r.best_peer_avg, r.gap_to_close) for r in rows] == [(5.0, None, None)]


def test_ranks_compare_the_values_themselves(spark):
    df = spark.createDataFrame([(0.1234561,), (0.1234562,), (0.1234563,), (1e15,), (1e300,), (-1e-9,), (-1e-10,), (0.0,)], "v double")
    got = {r.v: r.rank for r in peer_rank(df, "v").collect()}
    assert got == {v: 1 + sum(x > v for x in got) for v in got}
    wide = spark.createDataFrame([(Decimal("12345678901234567890.5"),), (Decimal("12345678901234567890.25"),)], "v decimal(38,12)")
    assert sorted((r.v, r.rank) for r in peer_rank(wide, "v").collect()) == [
        (Decimal("12345678901234567890.25"), 2), (Decimal("12345678901234567890.5"), 1)]
    longs = spark.createDataFrame([(2 ** 62 + i,) for i in range(5)], "v long")
    assert {r.v - 2 ** 62: r.rank for r in peer_rank(longs, "v").collect()} == {i: 5 - i for i in range(5)}
