import numpy as np
import pytest
from pyspark.sql import functions as F

from delayrisk.operators import forest as fo
from delayrisk.operators import model as mdl
from delayrisk.operators.stats import quantiles
from delayrisk.plans import inference as inf
from delayrisk.plans import training as tr
from delayrisk.sources.catalog import Tables
from delayrisk.staging import stage

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def labelled(spark):
    return stage(tr.labelled_features(Tables.from_fixture(spark, SF_SMALL)), "labelled")


def test_same_forest_on_any_partitioning(labelled):
    one = fo.fit(labelled.coalesce(1))
    assert one == fo.fit(labelled.repartition(13, F.rand(5))) == fo.fit(labelled.orderBy(F.desc("total_weight")))
    assert {n.tree for n in one} == set(range(mdl.TREES)) and max(n.node for n in one) < 2 << mdl.DEPTH
    assert len({tuple((n.node, n.feature, n.cut) for n in one if n.tree == t) for t in range(mdl.TREES)}) > 10


def test_expression_walks_the_node_table(spark, labelled):
    nodes = fo.from_table(fo.node_table(spark, fo.fit(labelled)))
    table = {(n.tree, n.node): n for n in nodes}
    for r in fo.score(labelled.withColumn("actual", F.col(mdl.LABEL)), nodes).limit(300).collect():
        shares = []
        for t in range(mdl.TREES):
            k = 1
            while table[t, k].feature is not None:
                k = 2 * k + (float(r[table[t, k].feature] or 0) > table[t, k].cut)
            shares.append(table[t, k].late / (table[t, k].late + table[t, k].timely))
        total = shares[0]
        for s in shares[1:]:
            total += s
        assert r.risk_factor == total / mdl.TREES * 100
        assert r[mdl.LABEL] == ("Delayed" if r.risk_factor >= 50 else "Not Delayed")


def test_scored_plan_is_native(spark, labelled):
    plan = fo.score(labelled, fo.fit(labelled, trees=3))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_as_good_as_the_library_forest(spark):
    data = stage(tr.labelled_features(Tables.from_fixture(spark, "/root/testdata/sf0.01")), "labelled")
    train, test = mdl.split_by_id(data)
    test = test.withColumnRenamed(mdl.LABEL, "actual")
    ours = mdl.evaluate(fo.score(test, fo.fit(train))).first()
    theirs = mdl.evaluate(mdl.score(test, mdl.fit(train))).first()
    assert ours.accuracy > theirs.accuracy - 0.02 and ours.f1 > theirs.f1 - 0.04


def test_odd_rows(spark):
    cols = f"{', '.join(f'{f} double' for f in fo.FEATURES)}, delivery_delay string, masterbill_internal_id long"
    rows = [(1.0, None, float(k % 5), None, 0.0, "Delayed" if k % 5 > 2 else "Not Delayed", k if k % 7 else None) for k in range(60)]
    rows += [rows[0]] * 5 + [(1.0, 1.0, 1.0, 1.0, 1.0, None, 3)]
    df = spark.createDataFrame(rows, cols)
    nodes = fo.fit(df, trees=4)
    assert any(n.feature == "total_weight" and n.cut == 2.0 for n in nodes)
    assert fo.score(df, nodes).count() == len(rows)
    none = fo.fit(df.limit(0), trees=2)
    assert [(n.tree, n.node, n.feature) for n in none] == [(0, 1, None), (1, 1, None)]
    assert {r.risk_factor for r in fo.score(df, none).collect()} == {50.0}


@pytest.mark.parametrize("picked, buckets", [(65536, 4096), (0, 3)])
def test_quantiles_are_the_order_statistics(spark, picked, buckets):
    rng = np.random.default_rng(7)
    values = [*rng.normal(size=9000), *[0.25] * 4000, *rng.integers(0, 3, 2000).astype(float), 1e300, -1e300]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(5)
    qs = [0.0, 1.0, 0.5, 0.31, 0.9999, 0.25, 1 / 32]
    want = sorted(values)
    assert quantiles(df, "v", qs, buckets, picked) == [want[int((len(want) - 1) * q)] for q in qs]


def test_median_reads_its_column_twice(spark):
    """A scan for the sketch, one for what it encloses; counts of the small rest."""
    df = stage(spark.range(50_000).select((F.col("id") % 9973).cast("double").alias("v")), "column")
    ids = []
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("median", "median")
    try:
        assert quantiles(df, "v", [0.5]) == [sorted(k % 9973 for k in range(50_000))[24_999]]
        ids = tracker.getJobIdsForGroup("median")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(ids) <= 9
