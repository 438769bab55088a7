"""Gold views that outlast a session, against their DataFrame form."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caremeter.plans.gold import GOLD_VIEWS, gold_view
from caremeter.plans.gold_sql import bodies, publish_gold
from caremeter.plans.silver import build_silver
from caremeter.sources.schemas import TABLES
from caremeter.sources.store import LayerStore
from harness.lake import Lake


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    lake, made = Lake(spark, "/root/testdata/sf0.001"), LayerStore(spark, str(tmp_path_factory.mktemp("gold")))
    for t in TABLES:
        made.write("silver", t, build_silver(t, lake.bronze[t]), "20260101")
    return made


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_rows_equal_the_dataframe_form(store, spark):
    assert publish_gold(store, "gold_a") == list(bodies())
    silver = {t: store.read("silver", t) for t in TABLES}
    other = spark.newSession()
    for name in GOLD_VIEWS:
        view, frame = other.table(f"gold_a.{name}"), gold_view(name, silver)
        assert view.dtypes == frame.dtypes, name
        assert rows(view) == rows(frame) and view.count() > 0, name
    sizes = [r.n_hospitals for r in other.sql("SELECT * FROM gold_a.vw_ownership_imaging_ed_stats").collect()]
    assert len(sizes) > 2 and sizes == sorted(sizes, reverse=True)
    assert sizes == [r.n_hospitals for r in gold_view("vw_ownership_imaging_ed_stats", silver).collect()]


def test_a_second_session_sees_the_next_refresh(store, spark):
    publish_gold(store, "gold_b")
    other = spark.newSession()
    assert not [v for v in other.catalog.listTables() if v.name in GOLD_VIEWS and v.isTemporary]
    before = {name: other.table(f"gold_b.{name}").count() for name in GOLD_VIEWS}
    hospitals = store.read("silver", "hospital_general")
    keep = [r[0] for r in other.table("gold_b.vw_imaging_vs_ed_wait").select("facility_id").limit(1).collect()]
    store.write("silver", "hospital_general", hospitals.where(F.col("facility_id").isin(keep)), "20260201")
    assert {name: other.table(f"gold_b.{name}").count() for name in GOLD_VIEWS} == before       # not published yet
    publish_gold(store, "gold_b")
    assert other.table("gold_b.dim_hospital").count() == 1 and other.table("gold_b.vw_imaging_vs_ed_wait").count() == 1
    store.write("silver", "hospital_general", hospitals.withColumn("more", F.lit(1)), "20260202")      # a column more
    publish_gold(store, "gold_b")
    assert {name: other.table(f"gold_b.{name}").count() for name in GOLD_VIEWS} == before


def test_views_wait_for_their_tables(store, spark, tmp_path):
    small = LayerStore(spark, str(tmp_path))
    small.write("silver", "hospital_general", store.read("silver", "hospital_general"), "20260101")
    assert publish_gold(small, "gold_c") == ["dim_hospital"]
    assert publish_gold(LayerStore(spark, str(tmp_path / "none")), "gold_d") == []
    assert spark.table("gold_c.dim_hospital").count() > 0
