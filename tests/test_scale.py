"""Steps whose tasks must not grow with the input, and work that must be done once."""

import math

import pytest

from delayrisk import ID
from delayrisk.operators import mart
from delayrisk.sources.catalog import Tables

from .conftest import SF_SMALL


@pytest.mark.parametrize("kind", ["long", "string"])
def test_large_page_is_dealt_by_range(spark, monkeypatch, kind):
    calls, real = [], mart.global_rank
    monkeypatch.setattr(mart, "TOP_ROWS", 5)
    monkeypatch.setattr(mart, "global_rank", lambda *a: calls.append(a) or real(*a))
    rows = [(None, k % 2) for k in range(12)] + [(k // 2, 0) for k in range(30)]
    order = [ID, "load_id"]
    df = spark.createDataFrame(rows, f"{ID} long, load_id long").selectExpr(f"cast({ID} as {kind}) as {ID}", "load_id").repartition(4)
    seen_rows, last, seen = [], None, 0
    while page := mart.page_after(df, last, seen, 9, order).collect():
        seen_rows += page
        last, seen = mart.cursor(page, last, seen, order)
    assert seen_rows == df.orderBy(*order).collect()
    assert len(calls) >= len(rows) // 9


def test_page_sorts_few_more_rows_than_it_has(spark):
    df = spark.range(100_000).selectExpr(f"case when id < 1000 then null else id end as {ID}")
    assert mart._first(df, ID, 500).count() == 1000
    assert 20_000 <= mart._first(df, ID, 20_000).count() < 21_000
    assert mart._first(df, ID, 10**6).count() == 100_000


def test_shuffles_start_with_parts_by_input_size(spark, monkeypatch, tmp_path):
    from delayrisk import session
    from delayrisk.staging import width

    df = spark.range(50_000)
    df.write.parquet(f"{tmp_path}/orders.parquet")
    size = sum(f.stat().st_size for f in (tmp_path / "orders.parquet").glob("*.parquet"))
    monkeypatch.setattr(session, "PART_BYTES", 4096)
    before = spark.conf.get(session.INITIAL_PARTITIONS, None)
    try:
        session.tune_for_size(spark, str(tmp_path))
        assert width(df) == math.ceil(size / 4096) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set(session.INITIAL_PARTITIONS, before) if before else spark.conf.unset(session.INITIAL_PARTITIONS)


def test_feature_rows_are_distinct_as_they_are_made(spark):
    from delayrisk.plans.feature_table import feature_table

    nan = float("nan")
    make = {
        "masterbill": ([(1,), (2,), (None,), (1,)], f"{ID} long"),
        "carrier": ([(1, None), (1, 0.0), (1, nan), (1, -0.0), (1, 5.0), (None, 3.0)], f"{ID} long, distance_km double"),
        "item_dimension": ([(1, "height", 2.0)], f"{ID} long, dimension_dim string, dimension double"),
        "item_weight": ([(1, "actual", 2.0)], f"{ID} long, weight_type string, weight double"),
        "itemgroup_line_item": ([(1, "true", "x")], f"{ID} long, hazardous_material_flag string, description string"),
        "masterbill_margins": ([(1, "CurrentMargin", nan), (1, "CurrentMargin", None), (1, "CurrentMargin", 7.0)],
                               f"{ID} long, margin_type string, margin_value double"),
    }
    t = Tables(spark, factories={k: (lambda v=v: spark.createDataFrame(*v)) for k, v in make.items()}, check=False)
    rows = feature_table(t, dedupe=True)
    assert rows._jdf.queryExecution().optimizedPlan().nodeName() != "Aggregate"  # no deduplication follows
    found = sorted((r["distance_km"], r["margin_value"]) for r in rows.filter(f"{ID} = 1").collect())
    assert found == [(0.0, 0.0), (0.0, 7.0), (5.0, 0.0), (5.0, 7.0)]
    assert rows.count() == 6


@pytest.mark.parametrize("name", ["forest_scores", "forest_predictions", "latest_version"])
def test_features_are_made_once(spark, monkeypatch, name):
    from delayrisk.operators import bag
    from delayrisk.queries import QUERIES

    calls, real = [], bag.factorised
    monkeypatch.setattr(bag, "factorised", lambda *a, **k: calls.append(a) or real(*a, **k))
    QUERIES[name](spark, SF_SMALL)
    assert len(calls) == 1


def test_predictions_stage_their_loads(spark, monkeypatch):
    from delayrisk.plans import inference as inf

    staged, real = [], inf.stage
    monkeypatch.setattr(inf, "stage", lambda df, label: staged.append(label) or real(df, label))
    inf.predictions(Tables.from_fixture(spark, SF_SMALL), inf.drawn_scorer())
    assert staged == ["loads"]
