"""A shipment that owns a third of all rows: results stay exact, and the
aggregations combine on the map side before any shuffle."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from delayrisk import ID
from delayrisk.operators import features as feat
from delayrisk.operators import labels as lab

N = 30000
HOT = 7


@pytest.fixture(scope="module")
def skewed(spark):
    base = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit(HOT)).otherwise(F.col("id") % 997).alias(ID),
        F.when(F.col("id") % 4 == 0, "billed").otherwise("actual").alias("weight_type"),
        (F.col("id") % 13).cast("double").alias("weight"),
        F.when(F.col("id") % 5 == 0, "true").when(F.col("id") % 7 == 0, None)
        .otherwise("false").alias("hazardous_material_flag"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.lit("d"), (F.col("id") % 50)
                                                                .cast("string"))).alias("description"),
        F.timestamp_add("DAY", F.col("id") % 40, F.lit(dt.datetime(2024, 1, 1))).alias("completion_date"),
        F.timestamp_add("DAY", F.col("id") % 37, F.lit(dt.datetime(2024, 1, 3))).alias("planned_date"),
    ).repartition(6)
    return base, base.toPandas()


def test_hot_key_holds_a_third(skewed):
    _, pdf = skewed
    assert (pdf[ID] == HOT).mean() > 0.33


def test_total_weight_exact(skewed):
    df, pdf = skewed
    want = pdf[pdf.weight_type == "actual"].groupby(ID)["weight"].sum().to_dict()
    got = {r[ID]: r["total_weight"] for r in feat.total_weight(df).collect()}
    assert got == want


def test_hazard_exact(skewed):
    df, pdf = skewed
    flag = pdf.hazardous_material_flag.map({"true": 1, "false": 0})
    want = {k: (None if pd.isna(v) else bool(v == 1))
            for k, v in flag.groupby(pdf[ID]).max().items()}
    got = {r[ID]: r["hazardous_material_flag"] for r in feat.hazmat_flag(df).collect()}
    assert got == want


def test_labels_exact(skewed):
    df, pdf = skewed
    g = pdf.dropna(subset=["completion_date", "planned_date"]).groupby(ID)
    want = {k: ("Delayed" if r.completion_date > r.planned_date else "Not Delayed")
            for k, r in g[["completion_date", "planned_date"]].max().iterrows()}
    got = {r[ID]: r["delivery_delay"] for r in lab.delay_labels(df).collect()}
    assert got == want


def test_description_set_exact_on_hot_key(spark, skewed):
    """An id takes its group descriptions; its lines' where it has none, and beside a missing one."""
    df, _ = skewed
    groups = df.filter(F.col("weight") < 4).select(ID, "description")
    lines = df.select(ID, "description")
    of_group, of_lines = {}, {}
    for frame, sets in ((groups, of_group), (lines, of_lines)):
        for i, text in frame.collect():
            sets.setdefault(i, set()).add(text)
    want = set()
    for i in of_group.keys() | of_lines.keys():
        mine, rest = of_group.get(i, set()), of_lines.get(i, set())
        if not mine or not rest:
            chosen = mine | rest
        else:
            chosen = (mine - {None}) | (rest if None in mine else set())
        want |= {(i, text) for text in chosen}
    got = [tuple(r) for r in feat.item_description(groups, lines).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("build", [
    lambda df: feat.total_weight(df), lambda df: feat.hazmat_flag(df),
    lambda df: lab.delay_labels(df), lambda df: feat.distance(df.withColumn("distance_km", F.col("weight"))),
])
def test_partial_aggregate_before_shuffle(skewed, build):
    df, _ = skewed
    plan = build(df)._jdf.queryExecution().executedPlan().toString()
    lines = [ln for ln in plan.split("\n") if "HashAggregate" in ln or "Exchange hashpartitioning" in ln]
    # bottom-up: partial aggregate, then the exchange on the id, then the final aggregate
    assert any("Exchange hashpartitioning(masterbill_internal_id" in ln for ln in lines)
    ex = max(i for i, ln in enumerate(lines) if "Exchange hashpartitioning(masterbill" in ln)
    assert any("HashAggregate" in ln for ln in lines[ex + 1:])


def test_left_join_fanout_equals_left_join_on_hot_key(spark):
    from delayrisk.operators.joins import left_join_fanout
    left = spark.createDataFrame([(i, f"l{i}") for i in range(50)] + [(None, "lnull"), (HOT, "lhot2")],
                                 f"{ID} long, lv string")
    right = spark.range(3000).select(
        F.when(F.col("id") % 3 != 0, F.lit(HOT)).otherwise(F.col("id") % 40 + 100).alias(ID),
        F.col("id").alias("rv")).unionByName(
        spark.createDataFrame([(None, -1), (3, 33)], f"{ID} long, rv long"))
    got = left_join_fanout(left, right, ID)
    want = left.join(right, ID, "left")
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert got.filter(F.col(ID) == HOT).count() == 2 * 2000


def test_left_join_fanout_plan_is_splittable(spark):
    from delayrisk.operators.joins import left_join_fanout
    left = spark.range(100).select(F.col("id").alias(ID), (F.col("id") * 2).alias("x"))
    right = spark.range(1000).select((F.col("id") % 10).alias(ID), F.col("id").alias("y"))
    old = (spark.conf.get("spark.sql.adaptive.enabled"),
           spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = left_join_fanout(left, right, ID)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[1])
    # one inner join carries the fan-out; the anti join works on distinct keys only
    assert "Inner" in plan and "LeftAnti" in plan and "LeftOuter" not in plan


def test_aqe_splits_hot_key_in_fanout_join(spark):
    """Run time proof: with a right side whose hot key holds two thirds of the
    rows, AQE splits that key's partition in the fan-out form, and cannot in
    a plain left outer join (it may split only the left side there)."""
    from delayrisk.operators.joins import left_join_fanout
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(200).select(F.col("id").alias("k"), F.lit("x").alias("lv"))
        right = spark.range(60000).select(
            F.when(F.col("id") % 3 != 0, F.lit(7)).otherwise(F.col("id") % 200).alias("k"),
            F.col("id").alias("rv"))
        fan = left_join_fanout(left, right, "k")
        plain = left.join(right, "k", "left")
        assert len(fan.collect()) == len(plain.collect()) == 60000
        fan_plan = fan._jdf.queryExecution().executedPlan().toString()
        plain_plan = plain._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in fan_plan
        assert "skew=true" not in plain_plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_feature_join_with_hot_description_id_matches_plain_left_joins(spark):
    from delayrisk.sources.catalog import Tables
    s = spark.createDataFrame
    lines = [(HOT, "true" if i % 7 == 0 else "false", f"d{i}") for i in range(300)]
    lines += [(i, "false", f"x{i % 3}") for i in range(20)] + [(None, "true", "n")]
    frames = {
        "masterbill": s([(i,) for i in range(25)] + [(None,)], f"{ID} long"),
        "carrier": s([(HOT, 5.0), (HOT, 6.0), (3, 1.0)], f"{ID} long, distance_km double"),
        "item_dimension": s([(HOT, "height", 2.0)], f"{ID} long, dimension_dim string, dimension double"),
        "item_weight": s([(HOT, "actual", 1.5)], f"{ID} long, weight_type string, weight double"),
        "itemgroup_line_item": s(lines, f"{ID} long, hazardous_material_flag string, description string"),
        "item_group": s([(HOT, None), (4, "g4")], f"{ID} long, description string"),
        "masterbill_margins": s([(HOT, "CurrentMargin", 9.0)], f"{ID} long, margin_type string, margin_value double"),
        "tracking_shipment_status": s([(HOT, "Drop")], f"{ID} long, event_type string"),
    }
    t = Tables(spark, factories={k: (lambda v=v: v) for k, v in frames.items()})
    got = feat.feature_join(t)
    p = feat.feature_parts(t)
    brute = feat.join_parts(feat.masterbill_ids(t["masterbill"]),
                            [p["distance"], p["item_volume"], p["total_weight"], p["hazmat_flag"],
                             p["margin"], p["drop_events"], p["item_description"]]).select(
        ID, "volume_cm3", "distance_km", "total_weight",
        F.coalesce("hazardous_material_flag", F.lit(False)).alias("hazardous_material_flag"),
        F.coalesce("margin_value", F.lit(0.0)).alias("margin_value"), "item_description").distinct()
    assert got.exceptAll(brute).count() == 0 and brute.exceptAll(got).count() == 0
    assert got.filter(F.col(ID) == HOT).count() == 2 * 301  # 2 distances x (300 lines + null group)
    assert got.filter(F.col(ID).isNull()).count() == 1
