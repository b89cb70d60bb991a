
import math

import pytest

from pyspark.sql import functions as F

from delayrisk import ID
from delayrisk.functions import risk as R
from delayrisk.operators import enrich, features as feat, impute, labels as lab, mart
from delayrisk.operators import profile
from delayrisk.sources.catalog import Tables


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


def test_l1_inch_rule_never_changes_a_side(spark):
    dims = spark.createDataFrame(
        [(1, "height", 2.0), (1, "width", 3.0), (1, "length", 4.0), (1, "inch", 10.0)],
        [ID, "dimension_dim", "dimension"])
    conv = rows(feat.convert_unit(dims), "dimension_dim")
    assert [r["dimension_cm"] for r in conv] == [2.0, 10.0 * 2.54, 4.0, 3.0]
    assert rows(feat.item_volume(dims)) == [{ID: 1, "volume_cm3": 24.0}]


def test_l1_separate_unit_column(spark):
    dims = spark.createDataFrame([(1, "height", 2.0, "inch")],
                                 [ID, "dimension_dim", "dimension", "unit"])
    out = feat.convert_unit(dims, unit_col="unit").first()
    assert out["dimension_cm"] == pytest.approx(5.08)


def test_l2_pick_rule_ignores_nulls_and_order(spark):
    dims = spark.createDataFrame(
        [(1, "height", None), (1, "height", 7.0), (1, "height", 5.0)],
        f"{ID} long, dimension_dim string, dimension_cm double")
    for n in (1, 3):
        got = feat.pivot_dimensions(dims.repartition(n)).first()
        assert got["height"] == 5.0 and got["width"] is None


def test_l3_missing_side_gives_null_volume_then_zero(spark):
    dims = spark.createDataFrame([(1, "height", 2.0), (1, "width", 3.0)],
                                 [ID, "dimension_dim", "dimension"])
    vol = feat.item_volume(dims)
    assert vol.first()["volume_cm3"] is None
    assert impute.fill_constants(vol, {"volume_cm3": 0.0}).first()["volume_cm3"] == 0.0


def test_l4_fills_repeatable_and_in_range(spark):
    ids = spark.range(0, 2000).select(F.col("id").alias(ID), F.lit(None).cast("double").alias("w"))
    a = impute.fill_uniform(ids, "w")
    b = impute.fill_uniform(ids.repartition(7), "w")
    assert rows(a, ID) == rows(b, ID)
    vals = [r["w"] for r in a.collect()]
    assert min(vals) >= 1.0 and max(vals) <= 2.0
    assert all(abs(v * 1000 - round(v * 1000)) < 1e-6 for v in vals)
    c = impute.fill_category(ids.withColumn("d", F.lit(None).cast("string")), "d")
    counts = {r["d"]: r["count"] for r in c.groupBy("d").count().collect()}
    assert set(counts) == {"MEDICAL MATERIAL", "Euro Pallet"}
    assert 800 < counts["Euro Pallet"] < 1200


def test_l4_present_values_untouched(spark):
    df = spark.createDataFrame([(1, 3.5), (2, None)], f"{ID} long, w double")
    out = {r[ID]: r["w"] for r in impute.fill_uniform(df, "w").collect()}
    assert out[1] == 3.5 and 1.0 <= out[2] <= 2.0


def _tables(spark, **frames):
    return Tables(spark, factories={k: (lambda v=v: v) for k, v in frames.items()})


def _freight(spark, ids, carrier=(), dims=(), weights=(), lines=(), groups=(), margins=(),
             status=()):
    s = spark.createDataFrame
    return _tables(
        spark,
        masterbill=s([(i,) for i in ids], f"{ID} long"),
        carrier=s(list(carrier), f"{ID} long, distance_km double"),
        item_dimension=s(list(dims), f"{ID} long, dimension_dim string, dimension double"),
        item_weight=s(list(weights), f"{ID} long, weight_type string, weight double"),
        itemgroup_line_item=s(list(lines),
                              f"{ID} long, hazardous_material_flag string, description string"),
        item_group=s(list(groups), f"{ID} long, description string"),
        masterbill_margins=s(list(margins), f"{ID} long, margin_type string, margin_value double"),
        tracking_shipment_status=s(list(status), f"{ID} long, event_type string"),
    )


def test_l5_bag_multiplies_sets_and_dedupe(spark):
    from delayrisk.plans.feature_table import feature_table
    t = _freight(spark, [1], carrier=[(1, 10.0), (1, 20.0)],
                 lines=[(1, "false", "a"), (1, "true", "b")])
    bag = feature_table(t)
    assert bag.count() == 4  # 2 distances x 2 descriptions
    assert feature_table(t, dedupe=True).count() == 2
    assert {r["hazardous_material_flag"] for r in bag.collect()} == {True}


def test_l6_flag_text(spark):
    lines = spark.createDataFrame(
        [(1, "true"), (2, "Y"), (3, "1"), (4, "maybe"), (5, None), (6, "false"), (6, None)],
        f"{ID} long, hazardous_material_flag string")
    got = {r[ID]: r["hazardous_material_flag"] for r in feat.hazmat_flag(lines).collect()}
    assert got == {1: True, 2: True, 3: True, 4: None, 5: None, 6: False}


def test_l7_margin_text_and_decimal_become_double(spark):
    m = spark.createDataFrame([(1, "CurrentMargin", "12.5")], f"{ID} long, margin_type string,"
                              " margin_value string")
    assert feat.current_margin(m).schema["margin_value"].dataType.simpleString() == "double"
    from decimal import Decimal
    d = spark.createDataFrame([(1, "CurrentMargin", Decimal("3.00"))], f"{ID} long, margin_type string,"
                              " margin_value decimal(10,2)")
    assert feat.current_margin(d).first()["margin_value"] == 3.0


@pytest.mark.parametrize("rf,exact,contig", [
    (50.0, "Normal", "Normal"), (50.5, None, "Low"), (51.0, "Low", "Low"),
    (70.4, None, "Medium"), (71.0, "Medium", "Medium"), (90.7, None, "High"),
    (91.0, "High", "High"), (100.0, "High", "High"), (float("nan"), None, None),
    (None, None, None), (-1.0, None, None), (100.5, None, None)])
def test_l8_bands(spark, rf, exact, contig):
    df = spark.createDataFrame([(rf,)], "r double")
    got = df.select(R.risk_level(F.col("r")).alias("a"),
                    R.risk_level(F.col("r"), contiguous=True).alias("b")).first()
    assert (got["a"], got["b"]) == (exact, contig)


def test_l11_search_does_not_match_none_text(spark):
    df = spark.createDataFrame(
        [(1, None, "x", "FAST", 10), (2, "a_b%c", "y", None, None)],
        f"{ID} long, Source string, Destination string, carrier_name string, load_id long")
    assert mart.search(df, "none").count() == 0
    assert [r[ID] for r in mart.search(df, "  A_B%C ").collect()] == [2]
    assert mart.search(df, "a%b").count() == 0  # '%' is literal, not a wildcard
    assert mart.search(df, "   ").count() == 2
    assert mart.search(df, None, none_text="None").count() == 2
    assert [r[ID] for r in mart.search(df, "none", none_text="None").collect()] == [1, 2]


def test_l13_kpis(spark):
    df = spark.createDataFrame(
        [("Delayed", 10.0, 1.0, True), ("Not Delayed", 20.0, None, False),
         ("Delayed", None, 2.25, None)],
        "delivery_delay string, distance_km double, total_weight double,"
        " hazardous_material_flag boolean")
    k = mart.kpis(df).first().asDict()
    assert k == {"delayed": 2, "avg_distance_km": 15.0, "avg_weight": 1.6, "hazardous": 1}


@pytest.mark.parametrize("label,cat,fb", [
    ("High", "High", 25.0), ("high risk", "High", 95.0), ("LATE", "High", 95.0),
    ("warning", "Medium", 80.0), (" at risk ", "Low", 60.0), ("On Time", "Normal", 25.0),
    (None, "Normal", 25.0), ("Delayed", "High", 95.0), ("low", "Low", 60.0)])
def test_l15_labels(spark, label, cat, fb):
    df = spark.createDataFrame([(label,)], "l string")
    got = df.select(R.norm_risk(F.col("l")).alias("c"), R.fallback_percent(F.col("l")).alias("f"))
    assert tuple(got.first()) == (cat, fb)


def test_l16_all_null_place_is_empty_text(spark):
    ev = spark.createDataFrame(
        [(1, "Pickup", None, None, None, None), (1, "Drop", "c", None, "US", "9"),
         (2, "Booked", "x", "y", "z", "w")],
        "master_bill_internal_id long, event_type string, city string, state string,"
        " country_code string, postal_code string")
    loc = rows(enrich.locations(ev))
    assert loc == [{"master_bill_internal_id": 1, "Source": "", "Destination": "c, US, 9"}]
    assert rows(enrich.locations(ev, null_empty=True))[0]["Source"] is None


def test_l17_labels_null_filter_and_ties(spark):
    import datetime as dt
    d = dt.datetime
    act = spark.createDataFrame(
        [(1, d(2024, 1, 5), d(2024, 1, 5)),              # equal -> on time
         (2, d(2024, 1, 9), None), (2, d(2024, 1, 2), d(2024, 1, 3)),  # row 1 dropped
         (3, d(2024, 1, 4), d(2024, 1, 1)), (3, d(2024, 1, 2), d(2024, 1, 6)),  # maxima 4 vs 6
         (4, None, None)],
        f"{ID} long, completion_date timestamp, planned_date timestamp")
    got = {r[ID]: r["delivery_delay"] for r in lab.delay_labels(act).collect()}
    assert got == {1: "Not Delayed", 2: "Not Delayed", 3: "Not Delayed"}
    act2 = spark.createDataFrame([(5, d(2024, 1, 7), d(2024, 1, 6))],
                                 f"{ID} long, completion_date timestamp, planned_date timestamp")
    assert lab.delay_labels(act2).first()["delivery_delay"] == "Delayed"


def test_l18_l19_spine_distinct_and_null_id(spark):
    from delayrisk.plans.feature_table import feature_table
    from delayrisk.plans.inference import scoring_input
    t = _freight(spark, [1, 1, None], carrier=[(1, 5.0)])
    ft = feature_table(t)
    got = rows(ft, ID)
    assert len(got) == 2 and got[0][ID] is None
    assert got[0]["distance_km"] == 0.0 and got[0]["margin_value"] == 0.0
    assert got[0]["hazardous_material_flag"] is False and 1.0 <= got[0]["total_weight"] <= 2.0
    si = scoring_input(t, ft)
    assert [r[ID] for r in si.collect()] == [1]  # null id lost in the inner join, no repeats


def test_l20_two_loads_two_rows(spark):
    df = spark.createDataFrame([(1, 0.5)], f"{ID} long, risk_factor double")
    loads = spark.createDataFrame([(1, 10, "A", "road"), (1, 11, "B", "air"), (2, 20, "C", "sea")],
                                  f"{ID} long, load_id long, carrier_name string, mode string")
    assert enrich.enrich_loads(df, loads).count() == 2


@pytest.mark.parametrize("text,want", [
    (" 12.5% ", 12.5), ("1,000", 100.0), ("-3", 0.0), ("", None), ("abc", None), ("nan", None),
    (None, None), ("55", 55.0), ("\t7%\n", 7.0), ("12d", None), ("1_0", 10.0), ("1__0", None),
    ("inf", 100.0), ("-Infinity", 0.0), ("1e1", 10.0), (".5", 0.5), ("0x10", None)])
def test_l21_to_percent(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(R.to_percent(F.col("t"))).first()[0] == want


def test_l21_nan_number_takes_label_fallback(spark):
    df = spark.createDataFrame([(float("nan"), "Low"), (None, "high risk"), (42.0, None)],
                               "risk_factor double, risk_level string")
    got = [r["percent"] for r in mart.display_columns(df).collect()]
    assert got == [60.0, 95.0, 42.0]


def test_percent_text_and_colours(spark):
    df = spark.createDataFrame([(None,), (12.5,), (13.5,), (50.0,), (70.0,), (90.0,), (90.1,),
                                (150.0,), (float("nan"),)], "p double")
    got = df.select(R.percent_text(F.col("p")).alias("t"), R.color_band(F.col("p")).alias("c"))
    assert [tuple(r) for r in got.collect()] == [
        ("—", "#2ecc71"), ("12%", "#2ecc71"), ("14%", "#2ecc71"), ("50%", "#2ecc71"),
        ("70%", "#f1c40f"), ("90%", "#e67e22"), ("90%", "#e74c3c"), ("100%", "#e74c3c"),
        ("100%", "#2ecc71")]


def test_null_profile_and_unique_ids(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (None, None)], f"{ID} long, v double")
    assert profile.null_profile(df).first().asDict() == {f"{ID}_null_count": 1, "v_null_count": 2}
    assert profile.unique_ids(df).first()[0] == 2
    empty = df.filter(F.lit(False))
    assert profile.null_profile(empty).first()[f"{ID}_null_count"] is None


def test_page_and_info(spark):
    df = spark.range(1, 26).select(F.col("id").alias(ID))
    info = mart.page_info(df, 9).first().asDict()
    assert info == {"rows": 25, "pages": 3, "page": 3}
    assert [r[ID] for r in mart.page(df, 2).collect()] == list(range(11, 21))
    assert [r[ID] for r in mart.page(df, 99).collect()] == list(range(21, 26))
    assert [r[ID] for r in mart.page_after(df, {ID: 20}, size=3).collect()] == [21, 22, 23]
    assert mart.page_info(df.filter(F.lit(False)), 1).first().asDict() == \
        {"rows": 0, "pages": 1, "page": 1}


def test_page_after_loses_no_row(spark):
    """Ids that straddle page ends, null ids and loads, rows that are alike in every column."""
    rows = [(1, 10), (1, 11), (1, 12), (2, None), (2, 20), (2, 20), (2, 20), (None, 5), (None, None), (3, 30)]
    df = spark.createDataFrame(rows, f"{ID} long, load_id long")
    for size in range(1, 12):
        got, last, seen = [], None, 0
        while True:
            page = mart.page_after(df, last, seen, size).collect()
            if not page:
                break
            last, seen = mart.cursor(page, last, seen)
            got += [tuple(r) for r in page]
        order = lambda r: [(v is not None, v or 0) for v in r]
        assert got == sorted(rows, key=order)


def test_deep_pages_are_ranked_by_parts(spark, monkeypatch):
    monkeypatch.setattr(mart, "TOP_ROWS", 10)
    df = spark.range(1, 58).select(F.col("id").alias(ID)).repartition(5)
    assert sorted(r[ID] for r in mart.page(df, 3).collect()) == list(range(21, 31))
    assert sorted(r[ID] for r in mart.page(df, 99).collect()) == list(range(51, 58))
    assert mart.page(df.filter("false"), 99).count() == 0


def test_head_rows_has_no_cap_of_its_own(spark):
    df = spark.range(7000).select(F.col("id").alias(ID))
    assert mart.head_rows(df, [ID]).count() == 7000
    assert [r[ID] for r in mart.head_rows(df, [ID], n=2).collect()] == [0, 1]


def test_conform_keeps_types_of_columns_that_exist(spark):
    out = mart.conform(spark.createDataFrame([("SHP-1", "85%")], f"{ID} string, risk_factor string"))
    assert tuple(out.select(ID, "risk_factor").first()) == ("SHP-1", "85%")
    assert mart.display_columns(out).first()["percent"] == 85.0


def test_nan_and_null_features_are_filled(spark):
    from delayrisk.plans.feature_table import fill_features
    nan = math.nan
    df = spark.createDataFrame([(1, nan, nan, nan, True, nan), (2, None, None, None, True, 1.0)],
                               f"{ID} long, volume_cm3 double, distance_km double, total_weight double,"
                               " hazardous_material_flag boolean, margin_value double")
    for r in fill_features(df).collect():
        assert all(v is not None and not math.isnan(v) for v in r)


def test_rand_is_an_option_of_the_fills(spark):
    from delayrisk.operators import impute
    df = spark.createDataFrame([(k, None, None) for k in range(50)], f"{ID} long, total_weight double, item_description string")
    a = impute.fill_uniform(df, "total_weight", seed=42).coalesce(1)
    assert all(1 <= r.total_weight <= 2 for r in a.collect())
    words = {r.item_description for r in impute.fill_category(df, "item_description", seed=42).collect()}
    assert words == set(impute.DESCRIPTION_CHOICES)


def test_conform_adds_typed_nulls(spark):
    df = spark.createDataFrame([(1, 0.3)], f"{ID} long, risk_factor double")
    out = mart.conform(df)
    assert out.columns == list(mart.MART_COLS)
    assert out.schema["load_id"].dataType.simpleString() == "bigint"
    assert out.first()["risk_factor"] == 0.3


def test_exact_median_distributed(spark):
    from delayrisk.operators.stats import quantile
    for vals in ([5.0], [1.0, 2.0], [3.0, 1.0, 2.0, 4.0], [1.0, 1.0, 1.0, 9.0, 9.0],
                 [float(i % 97) / 7 for i in range(1001)]):
        df = spark.createDataFrame([(v,) for v in vals] + [(None,), (math.nan,)], "v double")
        want = sorted(vals)[(len(vals) - 1) // 2]
        assert quantile(df, "v", 0.5, 0.0, buckets=4) == want
    assert quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.5, 0.0) is None
    approx = quantile(spark.range(1000).select(F.col("id").cast("double").alias("v")), "v", 0.5)
    assert abs(approx - 500) <= 20


def test_schema_check_at_boundary(spark):
    from delayrisk import schema
    t = Tables.from_fixture(spark, "/root/testdata/sf0.001")
    for name in schema.INPUTS:
        assert schema.check(t[name], schema.INPUTS[name], name, strict=True) == []
    bad = Tables(spark, factories={"carrier": lambda: spark.createDataFrame(
        [(1,)], f"{ID} long")})
    with pytest.raises(schema.SchemaError):
        bad["carrier"]
    text = Tables(spark, factories={"carrier": lambda: spark.createDataFrame(
        [(1, "5")], f"{ID} long, distance_km string")})
    assert text["carrier"].count() == 1  # a text distance is reported, cast later
    with pytest.raises(schema.SchemaError):
        Tables(spark, factories=text._factories, strict=True)["carrier"]


def test_kpi_text(spark):
    k = spark.createDataFrame([(12345, 1234.56, None, 7)],
                              "delayed long, avg_distance_km double, avg_weight double, hazardous long")
    assert tuple(mart.kpi_text(k).first()) == ("12,345", "1234.6", "—", "7")


def test_use_namespace(spark):
    from delayrisk.sources.catalog import use_namespace
    spark.sql("CREATE DATABASE IF NOT EXISTS ns_test")
    use_namespace(spark, "ns_test")
    try:
        assert spark.catalog.currentDatabase() == "ns_test"
    finally:
        use_namespace(spark, "default")


def test_exact_median_extreme_values(spark):
    from delayrisk.operators.stats import quantile
    vals = [-1.7e308, -1.0, 0.0, 2.5, 1.7e308]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    assert quantile(df, "v", 0.5, 0.0, buckets=4) == 0.0
    assert quantile(df, "v", 1.0, 0.0, buckets=4) == 1.7e308
    assert quantile(df, "v", 0.0, 0.0, buckets=4) == -1.7e308


def test_exact_median_adjacent_subnormals(spark):
    from delayrisk.operators.stats import quantile
    tiny = 5e-324
    df = spark.createDataFrame([(tiny,), (2 * tiny,), (2 * tiny,)], "v double")
    assert quantile(df, "v", 0.5, 0.0) == 2 * tiny
    assert quantile(df, "v", 0.0, 0.0) == tiny
