"""Properties: set semantics against brute force, invariance, monotone bands."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from delayrisk import ID
from delayrisk.functions import risk as R
from delayrisk.operators import features as feat
from delayrisk.sources.catalog import Tables

from .conftest import SF_SMALL

ids = st.one_of(st.none(), st.integers(0, 3))
descs = st.one_of(st.none(), st.sampled_from(["a", "b", "c"]))
pairs = st.lists(st.tuples(ids, descs), max_size=8)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(a=pairs, b=pairs)
def test_description_set_equals_outer_join(spark, a, b):
    """The pair-free description set equals the reference's full outer join."""
    schema = f"{ID} long, description string"
    ga, gb = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    x = ga.select(ID, F.col("description").alias("d1")).dropDuplicates().alias("x")
    y = gb.select(ID, F.col("description").alias("d2")).dropDuplicates().alias("y")
    brute = (x.join(y, F.col(f"x.{ID}") == F.col(f"y.{ID}"), "full_outer")
             .select(F.coalesce(f"x.{ID}", f"y.{ID}").alias(ID),
                     F.coalesce("x.d1", "y.d2").alias("item_description")).dropDuplicates())
    got = feat.item_description(ga, gb)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, brute.collect()), key=key)


def test_every_spine_id_has_features(spark):
    from delayrisk.plans.feature_table import feature_table
    t = Tables.from_fixture(spark, SF_SMALL)
    spine = feat.masterbill_ids(t["masterbill"])
    assert spine.join(feature_table(t), ID, "left_anti").count() == 0


def test_fills_unchanged_by_partitioning(spark):
    from delayrisk.plans.feature_table import feature_table
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        a = sorted(map(tuple, feature_table(Tables.from_fixture(spark, SF_SMALL)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    b = sorted(map(tuple, feature_table(Tables.from_fixture(spark, SF_SMALL)).collect()))
    assert a == b


def test_banding_is_monotone(spark):
    order = {"Normal": 0, "Low": 1, "Medium": 2, "High": 3}
    df = spark.range(0, 10001).select((F.col("id") / 100.0).alias("r"))
    got = df.select("r", R.risk_level(F.col("r"), contiguous=True).alias("l")).orderBy("r").collect()
    levels = [order[r["l"]] for r in got]
    assert levels == sorted(levels)
    assert all(r["l"] is not None for r in got)
