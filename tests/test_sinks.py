"""Writes: overwrite, schema growth, keyed tables, upsert."""

import pytest
from pyspark.sql import functions as F

from delayrisk.sources import sinks


def test_overwrite_growing_keeps_old_columns(spark):
    spark.sql("DROP TABLE IF EXISTS t_grow")
    spark.createDataFrame([(1, "a", 1.0)], "id long, x string, old double") \
        .write.saveAsTable("t_grow")
    sinks.overwrite_growing(spark.createDataFrame([(2, "b", True)], "id long, x string, new boolean"),
                            "t_grow")
    got = spark.table("t_grow")
    assert got.columns == ["id", "x", "old", "new"]
    assert [tuple(r) for r in got.collect()] == [(2, "b", None, True)]
    with pytest.raises(ValueError, match="type"):
        sinks.overwrite_growing(spark.createDataFrame([(1, 2)], "id long, x long"), "t_grow")
    assert spark.table("t_grow").count() == 1


def test_keyed_table_rejects_duplicates_and_null_keys(spark):
    dup = spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string")
    with pytest.raises(ValueError):
        sinks.create_keyed(dup, "t_keyed", ["id"])
    nul = spark.createDataFrame([(None, "a")], "id long, v string")
    with pytest.raises(ValueError):
        sinks.create_keyed(nul, "t_keyed", ["id"])


def test_upsert_replaces_keys_and_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (1, "a2"), (2, "b"), (None, "n")], "id long, v string")
    new = spark.createDataFrame([(1, "A"), (3, "C")], "id long, v string")
    once = sinks.upsert(old, new, ["id"])
    want = [(None, "n"), (1, "A"), (2, "b"), (3, "C")]
    assert sorted(map(tuple, once.collect()), key=str) == sorted(want, key=str)
    twice = sinks.upsert(once, new, ["id"])
    assert sorted(map(tuple, twice.collect()), key=str) == sorted(want, key=str)


def test_merge_into_table(spark):
    spark.sql("DROP TABLE IF EXISTS t_merge")
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    sinks.merge_into(base, "t_merge", ["id"])
    sinks.merge_into(spark.createDataFrame([(2, "B"), (3, "c")], "id long, v string"),
                     "t_merge", ["id"])
    got = sorted(tuple(r) for r in spark.table("t_merge").collect())
    assert got == [(1, "a"), (2, "B"), (3, "c")]
    left = [t.name for t in spark.catalog.listTables() if t.name.startswith("t_merge__")]
    assert left == []


def test_merge_refuses_what_breaks_the_key(spark):
    spark.sql("DROP TABLE IF EXISTS t_key")
    sinks.merge_into(spark.createDataFrame([(1, "a")], "id long, v string"), "t_key", ["id"])
    for bad in ([(1, "x"), (1, "y")], [(None, "n")]):
        with pytest.raises(ValueError):
            sinks.merge_into(spark.createDataFrame(bad, "id long, v string"), "t_key", ["id"])
    assert [tuple(r) for r in spark.table("t_key").collect()] == [(1, "a")]


class _Stops(Exception):
    pass


@pytest.mark.parametrize("after", range(5))
def test_a_swap_that_stops_loses_nothing(spark, monkeypatch, after):
    """Stop before each statement of the swap; the next merge finds the old or the new rows whole."""
    name = f"t_stop{after}"
    sinks.merge_into(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), name, ["id"])
    real, done = type(spark).sql, []

    def sql(self, text, *args, **kw):
        if text.startswith(("ALTER", "DROP")):
            if len(done) == after:
                raise _Stops(text)
            done.append(text)
        return real(self, text, *args, **kw)
    monkeypatch.setattr(type(spark), "sql", sql)
    try:
        sinks.merge_into(spark.createDataFrame([(2, "B"), (3, "c")], "id long, v string"), name, ["id"])
    except _Stops:
        pass
    monkeypatch.setattr(type(spark), "sql", real)
    sinks.merge_into(spark.createDataFrame([(4, "d")], "id long, v string"), name, ["id"])
    got = {tuple(r) for r in spark.table(name).collect()}
    assert got in ({(1, "a"), (2, "b"), (4, "d")}, {(1, "a"), (2, "B"), (3, "c"), (4, "d")})
    assert not [t.name for t in spark.catalog.listTables() if t.name in (f"{name}__old", f"{name}__ready")]


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("after", range(6))
def test_readers_find_whole_rows_after_any_stopped_statement(spark, monkeypatch, after, plain):
    """Stop before each catalog statement of a write; a pointer shows old or new rows without any repair."""
    name = f"t_seen{after}{'p' if plain else 'v'}"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    if plain:
        rows.write.saveAsTable(name)
    else:
        sinks.overwrite(rows, name)
        sinks.overwrite(rows, name)
    was = spark.table(name)
    real, done = type(spark).sql, []

    def sql(self, text, *args, **kw):
        if text.startswith(("ALTER", "DROP", "CREATE")):
            if len(done) == after:
                raise _Stops(text)
            done.append(text)
        return real(self, text, *args, **kw)
    monkeypatch.setattr(type(spark), "sql", sql)
    try:
        sinks.overwrite(spark.createDataFrame([(3, "c", 1)], "id long, v string, more int"), name)
    except _Stops:
        pass
    monkeypatch.setattr(type(spark), "sql", real)
    shown = sinks.read(spark, name) if plain else spark.table(name)
    assert [tuple(r) for r in shown.orderBy("id").collect()] in ([(1, "a"), (2, "b")], [(3, "c", 1)])
    if not plain:  # resolved before the write, read after it
        assert was.count() == 2
    sinks.overwrite(spark.range(4), name)
    assert sinks.read(spark, name).count() == 4 and len(sinks._versions(spark, name)) <= 2


def test_names_in_a_database_and_growing_versions(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS point_db")
    name = "point_db.Told"
    for k in range(4):
        sinks.overwrite_growing(spark.createDataFrame([(k,)], f"c{k} long"), name)
    assert sinks.read(spark, name).columns == ["c0", "c1", "c2", "c3"]
    assert len(sinks._versions(spark, name)) == 2
    assert sinks._pointer(spark, name).lower() == sinks._versions(spark, name)[-1]


def test_merged_rows_are_the_rows_checked(spark):
    """A source that changes between two reads can't slip a double key past the check."""
    unsure = spark.range(50).select((F.rand() * 3).cast("long").alias("id")).groupBy("id").count()
    sinks.merge_into(unsure, "t_unsure", ["id"])
    sinks.merge_into(unsure, "t_unsure", ["id"])
    sinks.assert_unique(spark.table("t_unsure"), ["id"])


def test_a_write_that_fails_keeps_the_old_table(spark):
    spark.sql("DROP TABLE IF EXISTS t_fail")
    sinks.overwrite(spark.range(3), "t_fail")
    with pytest.raises(Exception):
        sinks.overwrite(spark.range(3).select(F.raise_error(F.lit("stop")).cast("long").alias("id")), "t_fail")
    assert spark.table("t_fail").count() == 3


def test_upsert_into_bucketed_table_shuffles_only_new_keys(spark):
    spark.sql("DROP TABLE IF EXISTS t_bucketed")
    old = spark.range(0, 1000).select(F.col("id"), (F.col("id") * 2).alias("v"))
    sinks.create_keyed(old, "t_bucketed", ["id"])
    new = spark.range(500, 1500).select(F.col("id"), F.lit(-1).cast("long").alias("v"))
    prev = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = sinks.upsert(spark.table("t_bucketed"), new, ["id"])._jdf.queryExecution() \
            .executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", prev)
    assert plan.count("Exchange hashpartitioning") == 1  # the new keys only
    assert sinks.upsert(spark.table("t_bucketed"), new, ["id"]).count() == 1500
