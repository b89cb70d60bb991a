import random

import pytest
from pyspark.sql import functions as F

from delayrisk import ID
from delayrisk.operators import bag as B
from delayrisk.operators import features as feat
from delayrisk.operators import profile
from delayrisk.plans.feature_table import feature_table
from delayrisk.sources.catalog import Tables

from .conftest import SF_SMALL


def tables(spark, seed, hot=0):
    """Odd inputs: nulls in every column, ids on one side only, repeated rows, ids with large sets."""
    rng = random.Random(seed)
    some = lambda *xs: rng.choice(xs)
    i = lambda: some(None, *range(12))
    n = lambda: some(None, 0.0, 1.0, -0.0, float("nan"), 2.5)
    s = spark.createDataFrame
    carrier = [(i(), n()) for _ in range(40)] + [(3, float(k)) for k in range(hot)]
    lines = [(i(), some(None, "true", "false", "maybe"), some(None, "a", "b", "c")) for _ in range(40)]
    lines += [(3, "false", f"d{k}") for k in range(hot // 2)]
    return Tables(spark, factories={k: (lambda v=v: v) for k, v in {
        "masterbill": s([(k,) for k in (*range(10), None, 3, 3)], f"{ID} long"),
        "carrier": s(carrier, f"{ID} long, distance_km double"),
        "item_dimension": s([(i(), some("height", "width", "length", "inch", None), n()) for _ in range(60)],
                            f"{ID} long, dimension_dim string, dimension double"),
        "item_weight": s([(i(), some("actual", "other", None), some(None, 1.0, 2.0)) for _ in range(30)],
                         f"{ID} long, weight_type string, weight double"),
        "itemgroup_line_item": s(lines, f"{ID} long, hazardous_material_flag string, description string"),
        "item_group": s([(i(), some(None, "a", "g", "h")) for _ in range(15)], f"{ID} long, description string"),
        "masterbill_margins": s([(i(), some("CurrentMargin", "x"), n()) for _ in range(30)],
                                f"{ID} long, margin_type string, margin_value double"),
        "tracking_shipment_status": s([(3, "Drop")], f"{ID} long, event_type string"),
    }.items()})


def same(a, b):
    assert a.columns == b.columns and a.dtypes == b.dtypes
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("seed, wide", [(1, 1024), (2, 1), (3, 2)])
def test_expanded_rows_are_the_joined_rows(spark, seed, wide):
    t = tables(spark, seed, hot=6)
    same(B.expand(B.factorised(t), wide), feat.feature_join(t))
    same(B.expand(B.factorised(t, described=False), wide), feat.feature_join(t, with_description=False))


def test_same_on_the_fixture(spark):
    t = Tables.from_fixture(spark, SF_SMALL)
    same(B.expand(B.factorised(t)), feat.feature_join(t))


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_counts_and_median_need_no_rows(spark, seed):
    bag = B.factorised(tables(spark, seed, hot=9))
    rows = B.expand(bag)
    assert B.row_count(bag).first()[0] == rows.count()
    assert B.null_profile(bag).first() == profile.null_profile(rows).first()
    known = sorted(r[0] for r in rows.select("distance_km").collect() if r[0] is not None and r[0] == r[0])
    assert B.median_distance(bag, buckets=2) == B.median_distance(bag) == known[(len(known) - 1) // 2]
    got = B.repeated(B.descriptions(bag), "rows")
    same(got, rows.select(ID, "item_description"))


def test_empty_tables(spark):
    t = tables(spark, 1)
    none = Tables(spark, factories={k: (lambda v=t[k]: v.limit(0)) for k in (
        "masterbill", "carrier", "item_dimension", "item_weight", "itemgroup_line_item", "item_group", "masterbill_margins")})
    bag = B.factorised(none)
    assert B.expand(bag).count() == 0 and B.median_distance(bag) is None
    assert set(B.null_profile(bag).first()) == {None} and B.row_count(bag).first()[0] == 0


def test_a_hot_id_is_counted_without_its_product(spark):
    """10,000 distances times 1,000 descriptions: ten million rows that nothing forms."""
    base = tables(spark, 7)
    few = {k: (lambda v=base[k]: v) for k in ("masterbill", "item_dimension", "item_weight", "item_group", "masterbill_margins")}
    few["carrier"] = lambda: spark.range(10_000).select(F.lit(11).cast("long").alias(ID), F.col("id").cast("double").alias("distance_km"))
    few["itemgroup_line_item"] = lambda: spark.range(1_000).select(
        F.lit(11).cast("long").alias(ID), F.lit("false").alias("hazardous_material_flag"), F.col("id").cast("string").alias("description"))
    few["masterbill"] = lambda: spark.createDataFrame([(11,), (1,)], f"{ID} long")
    few["item_group"] = lambda: base["item_group"].limit(0)
    few["masterbill_margins"] = lambda: base["masterbill_margins"].limit(0)
    bag = B.factorised(Tables(spark, factories=few))
    assert B.row_count(bag).first()[0] == 10_000_001
    assert B.null_profile(bag).first().distance_km_null_count == 1 and B.median_distance(bag) == 4999.0


def test_few_exchanges(spark, monkeypatch):
    """What is staged and what is left of the feature table, planned without AQE and broadcasts."""
    staged, real = [], B.stage
    monkeypatch.setattr(B, "stage", lambda df, label: staged.append(df) or real(df, label))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        frames = [feature_table(Tables.from_fixture(spark, SF_SMALL))]
        inputs = sum(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(" + ID) for df in [*staged, *frames])
        assert inputs <= 6
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
