"""CSV to bronze to silver to gold, and what happens when a table fails."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from caremeter.plans.batch import run_batch
from caremeter.plans.bronze import load_bronze
from caremeter.plans.pipeline import refresh
from caremeter.plans.gold import GOLD_VIEWS, gold_view, register_gold
from caremeter.plans.silver import load_silver
from caremeter.sources.csvfiles import read_csv
from caremeter.sources.schemas import CSV_FILES, FACTS, RAW_COLUMNS, TABLES, bronze_schema
from caremeter.sources.store import LayerStore, StaleBatch

NEWLINES = ("hospital_general",)
T1, T2, T3 = (datetime(2026, 1, d, 12) for d in (1, 2, 3))


def csv_text(table, rows):
    def cell(v):
        return "" if v is None else '"' + v.replace('"', '""') + '"'
    names = RAW_COLUMNS[table]
    # header texts differ from the column names: columns bind by position
    return "\n".join([",".join(f"Header {i}" for i, _ in enumerate(names))]
                     + [",".join(cell(r.get(n)) for n in names) for r in rows]) + "\n"


def facility(i, **more):
    return {"facility_id": f"{i:06d}", "facility_name": f"Hospital {i}", "state": "PA", "hospital_type": "Acute Care Hospitals",
            "hospital_ownership": "Government - Local", "hospital_overall_rating": str(i % 5 + 1), **more}


def fact(i, measure, score, **more):
    return {"facility_id": f"{i:06d}", "measure_id": measure, "measure_name": measure, "score": score,
            "start_date": "01/01/2024", "end_date": "12/31/2024", **more}


ROWS = {
    "hospital_general": [facility(1), facility(2, facility_name='The "Old", big\nhouse', county="", city=None), facility(3),
                         facility(4, hospital_ownership="Tribal")],
    "timely_care": [
        fact(1, "OP_18a", "1440", condition="Emergency Department"), fact(1, "OP_18b", "1441", condition="Emergency Department"),
        fact(2, "OP_18a", "100", condition="Emergency Department"), fact(2, "OP_18b", "200.5", condition="Emergency Department"),
        fact(4, "OP_18a", "50", condition="Emergency Department"),
        fact(9, "OP_18a", "10", condition="Emergency Department"),
        fact(1, "OP_29", "80", condition="Colonoscopy care"), fact(2, "IMM_3", "90", condition="Healthcare Personnel Vaccination"),
        fact(2, "OP_22", "3", condition="Emergency Department", footnote="3, 13")],
    "outpatient_imaging": [fact(1, "OP-10", "4"), fact(1, "OP-8", "90"), fact(2, "OP-10", "5"), fact(2, "OP-13", "6.01"),
                           fact(3, "OP-10", "1"), fact(4, "OP-39", "2"), fact(9, "OP-39", "2")],
    "complications": [fact(1, m, "1", compared_to_national=c) for m, c in
                      (("MORT_1", "Worse Than"), ("PSI_03", "No Different Than"), ("COMP_1", "Better Than"))]
                     + [fact(2, m, "1", compared_to_national="No Different Than") for m in ("MORT_1", "PSI_03")],
    "infections": [fact(1, "HAI_1_SIR", "0.5"), fact(1, "HAI_1_SIR", "0.5"), fact(2, "HAI_2_SIR", None, footnote="8")],
}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    src = tmp_path_factory.mktemp("csv")
    for table, rows in ROWS.items():
        (src / CSV_FILES[table]).write_text(csv_text(table, rows), encoding="utf-8", newline="")
    store = LayerStore(spark, str(tmp_path_factory.mktemp("store")))
    logs = [load_bronze(spark, str(src), store, T1, multi_line=NEWLINES), load_silver(spark, store, T1)]
    return src, store, [{r.table_name: r for r in log.collect()} for log in logs]


def test_run_log(loaded):
    _, store, logs = loaded
    for log, layer in zip(logs, ("bronze", "silver")):
        assert {t: (r.status, r.row_count, r.layer) for t, r in log.items()} == {t: ("ok", len(ROWS[t]), layer) for t in TABLES}
        assert all(r.seconds >= 0 and r.batch_start == T1 and r.error is None for r in log.values())


def test_csv_text_is_kept(loaded):
    _, store, _ = loaded
    rows = {r.facility_id: r for r in store.read("bronze", "hospital_general").collect()}
    assert rows["000002"].facility_name == 'The "Old", big\nhouse'
    assert rows["000002"].county == "" and rows["000002"].city is None
    assert {r.dwh_load_date for r in rows.values()} == {T1}
    assert {r.dwh_create_date for r in store.read("silver", "infections").collect()} == {T1}


def test_views(loaded, spark):
    _, store, _ = loaded
    silver = {t: store.read("silver", t) for t in TABLES}
    g2 = {r.facility_id: r for r in gold_view("vw_imaging_vs_ed_wait", silver).collect()}
    assert set(g2) == {"000001", "000002", "000004"}   # 3 has no wait, 9 is not in the dimension
    assert (g2["000001"].avg_ed_wait_minutes, g2["000001"].ed_measures_used) == (Decimal("1440.00"), 1)   # 1441 is out
    assert (g2["000001"].avg_imaging_score, g2["000001"].imaging_measures_used) == (Decimal("4.00"), 1)   # OP-8 is out
    assert g2["000002"].avg_imaging_score == Decimal("5.51") and g2["000002"].avg_ed_wait_minutes == Decimal("150.25")
    g3 = gold_view("vw_ownership_imaging_ed_stats", silver).collect()
    assert [(r.hospital_ownership, r.n_hospitals) for r in g3] == [("Government", 2)]
    g4 = gold_view("vw_complications_vs_process_care", silver).collect()
    assert [(r.facility_id, r.comp_rated_total, r.complication_pct_worse, r.mort_pct_worse, r.psi_pct_worse) for r in g4] == [
        ("000001", 3, Decimal("33.33"), Decimal("100.00"), Decimal("0.00"))]   # two rated measures are too few
    register_gold(store)
    assert spark.sql("SELECT count(*) FROM vw_imaging_vs_ed_wait").first()[0] == 3
    assert {v.name for v in spark.catalog.listTables()} >= set(GOLD_VIEWS)


def test_publish_and_register(loaded, spark):
    _, store, _ = loaded
    store.register("silver", FACTS)
    assert spark.sql("SELECT count(*) FROM silver_infections WHERE measure_suffix = 'SIR'").first()[0] == 3
    store.publish("silver", ["infections"])
    assert spark.sql("SELECT count(*) FROM silver.infections").first()[0] == 3


def test_failed_table_keeps_its_rows(loaded, spark):
    src, store, _ = loaded
    good = (src / CSV_FILES["infections"]).read_text()
    try:
        (src / CSV_FILES["infections"]).write_text("a,b\n1,2\n")
        log = {r.table_name: r for r in load_bronze(spark, str(src), store, T2, multi_line=NEWLINES).collect()}
    finally:
        (src / CSV_FILES["infections"]).write_text(good)
    assert log["infections"].status == "failed" and log["infections"].error and log["infections"].row_count is None
    assert all(log[t].status == "ok" for t in TABLES if t != "infections")
    kept = store.read("bronze", "infections").collect()
    assert len(kept) == 3 and {r.dwh_load_date for r in kept} == {T1}
    assert {r.dwh_load_date for r in store.read("bronze", "timely_care").collect()} == {T2}
    missing = {r.table_name: r for r in load_bronze(spark, str(src), store, T3, {"infections": "no-such-file.csv"}).collect()}
    assert missing["infections"].status == "failed"
    store.drop_old("bronze", "timely_care")
    assert len(store.batches("bronze", "timely_care")) == 1


def test_refresh_runs_everything(loaded, spark, tmp_path):
    src, _, _ = loaded
    log = refresh(spark, str(src), LayerStore(spark, str(tmp_path)), multi_line=NEWLINES).collect()
    assert [(r.layer, r.status) for r in log] == [("bronze", "ok")] * 5 + [("silver", "ok")] * 5
    assert spark.sql("SELECT count(*) FROM vw_complications_vs_process_care").first()[0] == 1


def test_wrong_field_count_fails(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text(csv_text("infections", ROWS["infections"]) + "too,few\n")
    with pytest.raises(Exception):
        read_csv(spark, str(path), bronze_schema("infections")).collect()


def test_refresh_replaces_rows(loaded, spark):
    src, store, _ = loaded
    load_bronze(spark, str(src), store, datetime(2026, 2, 1), {"infections": CSV_FILES["infections"]}).collect()
    assert store.read("bronze", "infections").count() == 3
    assert len(store.batches("bronze", "infections")) == 2


def small(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("facility_id"))


def test_batch_can_be_tried_again_after_a_crash(spark, tmp_path):
    store = LayerStore(spark, str(tmp_path))
    with pytest.raises(Exception):
        store.write("bronze", "t", small(spark, 3).select(F.raise_error(F.lit("lost"))), "20260101")
    assert not store.has("bronze", "t")
    store.write("bronze", "t", small(spark, 3), "20260101")
    store.write("bronze", "t", small(spark, 4), "20260101")      # the same batch once more replaces it
    assert store.read("bronze", "t").count() == 4


def test_older_batch_is_refused_and_logged(spark, tmp_path):
    store = LayerStore(spark, str(tmp_path))
    builds = {"t": lambda: small(spark, 5)}
    assert run_batch(spark, store, "bronze", builds, "at", T2).first().status == "ok"
    late = run_batch(spark, store, "bronze", builds, "at", T1).first()
    assert late.status == "stale" and "is older" in late.error and late.row_count is None
    assert {r["at"] for r in store.read("bronze", "t").collect()} == {T2}


class Interleaved(LayerStore):
    """Lets others act between the last look at the commits and the creation of the file."""
    others: list = []

    def _take(self, *args):
        if self.others:
            self.others.pop(0)()
        return super()._take(*args)


def test_writers_that_meet_take_different_numbers(spark, tmp_path):
    a, b = Interleaved(spark, str(tmp_path)), LayerStore(spark, str(tmp_path))
    a.others = [lambda: b.write("bronze", "t", small(spark, 2), "20260101"), lambda: b.write("bronze", "t", small(spark, 3), "20260102")]
    a.write("bronze", "t", small(spark, 4), "20260103")
    assert [spark.read.parquet(p).count() for p in a.batches("bronze", "t")] == [2, 3, 4]
    assert sorted(p.name for p in (tmp_path / "bronze/t/commits").glob("0*")) == [f"{n:012d}" for n in (1, 2, 3)]


def test_older_writer_loses_whenever_it_commits(spark, tmp_path):
    a, b = Interleaved(spark, str(tmp_path)), LayerStore(spark, str(tmp_path))
    a.others = [lambda: b.write("bronze", "t", small(spark, 5), "20260109")]
    with pytest.raises(StaleBatch):
        a.write("bronze", "t", small(spark, 4), "20260103")
    assert a.read("bronze", "t").count() == 5 and len(a.batches("bronze", "t")) == 1
    # the worst case: the newer writer has its number but not yet written the name, so nobody can see it
    c = Interleaved(spark, str(tmp_path / "c"))
    commits = tmp_path / "c/bronze/t/commits"
    late = small(spark, 7)
    late.write.parquet(f"{tmp_path}/c/bronze/t/data/20260109-slow")
    commits.mkdir(parents=True)
    (commits / "000000000001").touch()
    c.write("bronze", "t", small(spark, 4), "20260103")
    (commits / "000000000001").write_text("20260109-slow\n")
    assert c.read("bronze", "t").count() == 7 and [spark.read.parquet(p).count() for p in c.batches("bronze", "t")] == [4, 7]


def test_a_lost_writer_commits_nothing(spark, tmp_path):
    store = LayerStore(spark, str(tmp_path))
    store.write("bronze", "t", small(spark, 1), "20260101")
    for name, text in (("000000000002", ""), ("000000000003", "20260105-half")):
        (tmp_path / "bronze/t/commits" / name).write_text(text)
    assert store.read("bronze", "t").count() == 1
    store.write("bronze", "t", small(spark, 2), "20260102")
    assert store.read("bronze", "t").count() == 2
    store.drop_old("bronze", "t")
    assert store.read("bronze", "t").count() == 2 and len(store.batches("bronze", "t")) == 1


def test_old_and_uncommitted_data_goes(spark, tmp_path):
    store = LayerStore(spark, str(tmp_path))
    for day in (1, 2, 3, 4):
        run_batch(spark, store, "bronze", {"t": lambda: small(spark, day)}, "at", datetime(2026, 1, day)).collect()
    assert [len(store.spark.read.parquet(p).collect()) for p in store.batches("bronze", "t")] == [3, 4]
    small(spark, 1).write.parquet(f"{tmp_path}/bronze/t/data/20260105T000000-abandoned")
    store.drop_old("bronze", "t")
    assert len(list((tmp_path / "bronze/t/data").iterdir())) == 2          # it may still be written
    store.drop_old("bronze", "t", grace_seconds=0)
    assert len(list((tmp_path / "bronze/t/data").iterdir())) == 1 and store.read("bronze", "t").count() == 4
    with pytest.raises(ValueError):
        store.drop_old("bronze", "t", keep=0)


def test_published_table_moves_without_a_gap(spark, tmp_path):
    store = LayerStore(spark, str(tmp_path))
    for day in (1, 2):
        store.write("bronze", "moved", small(spark, day), f"2026010{day}")
        store.publish("bronze", ["moved"])
        assert spark.table("bronze.moved").count() == day
    store.write("bronze", "moved", small(spark, 3).withColumn("more", F.lit(1)), "20260103")
    store.publish("bronze", ["moved"])
    assert spark.table("bronze.moved").columns == ["facility_id", "more"] and spark.table("bronze.moved").count() == 3


def test_refresh_of_an_empty_folder_returns_the_log(spark, tmp_path):
    log = refresh(spark, str(tmp_path / "none"), LayerStore(spark, str(tmp_path / "store"))).collect()
    assert len(log) == 10 and {r.status for r in log} == {"failed"} and all(r.error for r in log)


def test_error_text_is_whole(spark, tmp_path):
    def fail():
        raise RuntimeError("first line\n" + "x" * 2000)
    row = run_batch(spark, LayerStore(spark, str(tmp_path)), "bronze", {"t": fail}, "at", T1).first()
    assert row.error == "first line\n" + "x" * 2000


def test_one_file_is_split_and_a_newline_fails_it(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text(csv_text("infections", [fact(i, "HAI_1_SIR", "0.5") for i in range(3000)]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
        df = read_csv(spark, str(path), bronze_schema("infections"))
        assert df.rdd.getNumPartitions() > 4 and df.count() == 3000 == df.select("facility_id").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for field in ("facility_name", "end_date"):
        path.write_text(csv_text("infections", [{**fact(1, "HAI_1_SIR", "0.5"), field: "two\nlines"}]))
        with pytest.raises(Exception):
            read_csv(spark, str(path), bronze_schema("infections")).collect()
        assert read_csv(spark, str(path), bronze_schema("infections"), multi_line=True).count() == 1
