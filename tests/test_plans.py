"""Plan shape: the optimizations the jobs rely on are really in the physical plan."""

import pytest

import __spark_entry__ as entry

from .conftest import SF_SMALL


def _plan(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast_no_aqe(spark):
    old = (spark.conf.get("spark.sql.autoBroadcastJoinThreshold"),
           spark.conf.get("spark.sql.adaptive.enabled"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
    spark.conf.set("spark.sql.adaptive.enabled", old[1])


def test_dead_drop_event_join_removed(spark, no_broadcast_no_aqe):
    plan = _plan(spark, "feature_join")
    # the never-read drop-event part is pruned with its join and its scan
    assert "events.parquet" not in plan
    # left joins: the three one-row parts in the chain, and the flags inside
    # the description set, which is staged; distances, margins and
    # descriptions are joined by the fan-out form (inner + anti)
    assert plan.count("LeftOuter") == 4
    assert plan.count("LeftAnti") == 3


def test_final_distinct_needs_no_extra_exchange(spark, no_broadcast_no_aqe):
    df = entry.queries()["feature_join"](spark, SF_SMALL)
    top = df._jdf.queryExecution().executedPlan().toString().split("\n")[:6]
    assert not any("Exchange" in line for line in top)


def test_pivot_is_one_aggregate(spark, no_broadcast_no_aqe):
    plan = _plan(spark, "dimension_pivot")
    assert plan.count("Exchange hashpartitioning(masterbill_internal_id") == 1


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(spark, "delay_labels")
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan
    assert "o_totalprice" not in plan


@pytest.fixture(scope="module")
def catalog_tables(spark):
    """The fixture's freight tables written as catalog tables (silver/gold)."""
    from delayrisk.sources.catalog import INPUT_TABLES, Tables
    fx = Tables.from_fixture(spark, SF_SMALL)
    spark.sql("CREATE DATABASE IF NOT EXISTS silver")
    spark.sql("CREATE DATABASE IF NOT EXISTS gold")
    for name in INPUT_TABLES:
        target = "gold.fact_load" if name == "fact_load" else f"silver.silver_{name}"
        fx[name].write.mode("overwrite").saveAsTable(target)
    return Tables.from_catalog(spark, schema="silver")


def test_filters_and_columns_reach_the_scan(spark, catalog_tables, monkeypatch):
    from delayrisk.operators import bag
    from delayrisk.plans.feature_table import feature_table
    staged, real = [], bag.stage
    monkeypatch.setattr(bag, "stage", lambda df, label: staged.append(df) or real(df, label))
    last = feature_table(catalog_tables)  # what it stages has the scans
    plan = "\n".join(df._jdf.queryExecution().executedPlan().toString() for df in (*staged, last))
    assert "EqualTo(weight_type,actual)" in plan
    assert "EqualTo(margin_type,CurrentMargin)" in plan
    scans = [ln for ln in plan.split("\n") if "FileScan" in ln]
    # the drop-event table is never scanned: its join is removed
    assert not any("silver_tracking_shipment_status" in ln for ln in scans)
    # the weight scan reads only the three columns it uses
    weight = [ln for ln in scans if "silver_item_weight" in ln][0]
    assert "ReadSchema: struct<masterbill_internal_id:bigint,weight_type:string,weight:double>" \
        in weight


def test_catalog_and_fixture_agree(spark, catalog_tables):
    from delayrisk.plans.feature_table import feature_table
    from delayrisk.sources.catalog import Tables
    a = feature_table(catalog_tables)
    b = feature_table(Tables.from_fixture(spark, SF_SMALL))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _scans(df, table):
    return [ln for ln in df._jdf.queryExecution().executedPlan().toString().split("\n")
            if "FileScan" in ln and table in ln]


def test_descriptions_scan_each_input_once(spark, catalog_tables, monkeypatch):
    """What is staged reads each input once; what follows reads only what was staged."""
    from delayrisk.operators import features as feat
    staged = []
    real = feat.stage
    monkeypatch.setattr(feat, "stage", lambda df, label: staged.append(df) or real(df, label))
    t = catalog_tables
    final = feat.item_description(t["item_group"], t["itemgroup_line_item"])
    for name in ("silver_item_group", "silver_itemgroup_line_item"):
        assert [len(_scans(df, name)) for df in (*staged, final)] == [1, 0]
    staged.clear()
    bag = feat.feature_join(t)
    assert sum(len(_scans(df, "silver_itemgroup_line_item")) for df in (*staged, bag)) == 1
    assert sum(len(_scans(df, "silver_item_group")) for df in (*staged, bag)) == 1


def test_distinct_ids_need_no_join(spark, no_broadcast_no_aqe):
    plan = _plan(spark, "unique_masterbills")
    assert "Join" not in plan and plan.count("Exchange") == 2


def test_kpis_read_four_columns(spark):
    """The mart reads a written table: columns are pruned and filters pushed to the scan."""
    plan = _plan(spark, "kpis")
    scan = [ln for ln in plan.split("\n") if "FileScan parquet" in ln]
    assert len(scan) == 1
    assert "ReadSchema: struct<distance_km:double,total_weight:double,hazardous_material_flag:boolean," \
        "delivery_delay:string>" in scan[0]


def test_left_side_planned_once(spark, no_broadcast_no_aqe):
    """Loads and upserts scan the order lines behind their left side no more than the side itself does."""
    once = _plan(spark, "scoring_input").count("lineitem.parquet")
    assert _plan(spark, "enrich_loads").count("lineitem.parquet") <= once + 2      # the loads, and their ids
    assert _plan(spark, "upsert_by_key").count("part.parquet") == 0                # features are read as written


def test_loads_are_distinct_before_they_fan_out(spark, no_broadcast_no_aqe):
    """No deduplication follows the joins of the predictions."""
    top = _plan(spark, "delay_predictions").split("\n")[:8]
    assert not any("HashAggregate" in ln for ln in top)


def test_stale_rows_are_never_returned(spark, tmp_path):
    import shutil
    folder = tmp_path / "sf"
    shutil.copytree(SF_SMALL, folder)
    folder.chmod(0o755)
    q = entry.queries()["dashboard_mart"]
    before = q(spark, str(folder)).count()
    orders = spark.read.parquet(f"{folder}/orders.parquet").limit(100).toPandas()
    spark.createDataFrame(orders).coalesce(1).write.parquet(str(tmp_path / "few"))
    (part,) = (tmp_path / "few").glob("*.parquet")
    (folder / "orders.parquet").chmod(0o644)  # the test data are read-only
    shutil.copyfile(part, folder / "orders.parquet")
    spark.catalog.refreshByPath(str(folder))
    assert q(spark, str(folder)).count() < before
