"""Test-fixture adapter: the driver's TPC-H-like tables seen as freight tables.

The freight tables the jobs read (masterbill, activity, carrier, ...) do not
exist in the test data, so each one is defined here as a DataFrame over the
driver's parquet tables (FIXTURES.md section 3 gives the same mapping as SQL,
used by the DuckDB oracle).  Every view reads whole tables and keeps every row;
missing rows come from the data: orders without lines have no weights, lines
or loads, and customers in debt have no distance and no group description.

Each view is lazy; Catalyst prunes the parquet columns it does not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ID

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
)


def _days(n, ts: Column) -> Column:
    """``ts + n days`` keeping the timestamp type (NTZ stays NTZ)."""
    return F.timestamp_add("DAY", n if isinstance(n, Column) else F.lit(n), ts)


class DriverTables:
    """Lazy readers for the driver's parquet tables in one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._readers: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in DRIVER_TABLES:
            raise AttributeError(name)
        if name not in self._readers:
            self._readers[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._readers[name]


def masterbill(d: DriverTables) -> DataFrame:
    return d.orders.select(F.col("o_orderkey").alias(ID))


def activity(d: DriverTables) -> DataFrame:
    li = d.lineitem.select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_quantity")
    o = d.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    c = d.customer.select("c_custkey", "c_nationkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    ts = F.col("o_orderdate")
    off = F.abs(F.col("c_nationkey") - 12)
    completion = (F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 7), None)
                  .otherwise(_days(F.col("l_quantity").cast("int"), ts)))
    planned = (F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 6), None)
               .when(off >= 10, _days(30, ts))
               .when(off >= 7, _days(38, ts))
               .when(off >= 4, _days(44, ts))
               .otherwise(_days(48, ts)))
    return j.select(F.col("l_orderkey").alias(ID),
                    completion.alias("completion_date"),
                    planned.alias("planned_date"))


def carrier(d: DriverTables) -> DataFrame:
    o = d.orders.select("o_orderkey", "o_custkey")
    c = d.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    dist = (F.when(F.col("c_acctbal") < 0, None)
            .otherwise((F.abs(F.col("c_nationkey") - 12) * 100 + F.col("c_custkey") % 100)
                       .cast("double")))
    main = (o.join(c, o.o_custkey == c.c_custkey)
            .select(F.col("o_orderkey").alias(ID), dist.alias("distance_km")))
    # Urgent orders have a second, short leg.
    extra = (d.orders.filter(F.col("o_orderpriority") == "1-URGENT")
             .select(F.col("o_orderkey").alias(ID), F.lit(1.0).alias("distance_km")))
    return main.unionByName(extra)


def _lines_with_part(d: DriverTables, *cols: str) -> DataFrame:
    li = d.lineitem.select("l_orderkey", "l_partkey", "l_linenumber")
    p = d.part.select("p_partkey", *cols)
    return li.join(p, li.l_partkey == p.p_partkey)


def item_dimension(d: DriverTables) -> DataFrame:
    ln = F.col("l_linenumber")
    dim = (F.when(ln.isin(1, 4), "height").when(ln.isin(2, 5), "width")
           .when(ln.isin(3, 6), "length").otherwise("inch"))
    return _lines_with_part(d, "p_size").select(
        F.col("l_orderkey").alias(ID), dim.alias("dimension_dim"),
        F.col("p_size").cast("double").alias("dimension"))


def item_weight(d: DriverTables) -> DataFrame:
    return d.lineitem.select(
        F.col("l_orderkey").alias(ID),
        F.when(F.col("l_returnflag") == "N", "billed").otherwise("actual").alias("weight_type"),
        F.col("l_quantity").alias("weight"))


def itemgroup_line_item(d: DriverTables) -> DataFrame:
    flag = (F.when(F.col("p_type") == "PROMO", "true")
            .when(F.col("p_type") == "SMALL", None).otherwise("false"))
    desc = F.when(F.col("l_linenumber") == 5, None).otherwise(F.col("p_name"))
    return _lines_with_part(d, "p_type", "p_name").select(
        F.col("l_orderkey").alias(ID), flag.alias("hazardous_material_flag"),
        desc.alias("description"))


def item_group(d: DriverTables) -> DataFrame:
    """One description per order, lines or not; null where the customer is in debt."""
    o = d.orders.select("o_orderkey", "o_custkey")
    c = d.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    desc = F.when(F.col("c_acctbal") < 0, None).otherwise(F.col("c_mktsegment"))
    return (o.join(c, o.o_custkey == c.c_custkey)
            .select(F.col("o_orderkey").alias(ID), desc.alias("description")))


def masterbill_margins(d: DriverTables) -> DataFrame:
    return d.orders.select(
        F.col("o_orderkey").alias(ID),
        F.when(F.col("o_orderstatus") == "P", "PlannedMargin")
        .otherwise("CurrentMargin").alias("margin_type"),
        F.col("o_totalprice").alias("margin_value"))


def tracking_shipment_status(d: DriverTables) -> DataFrame:
    et = F.col("event_type")
    return d.events.select(
        F.col("event_id").alias(ID),
        F.when(et == "purchase", "Drop").when(et == "signup", "Pickup")
        .otherwise("InTransit").alias("event_type"))


def event(d: DriverTables) -> DataFrame:
    geo = (d.nation.select("n_nationkey", "n_name", "n_regionkey")
           .join(d.region.select("r_regionkey", "r_name"),
                 F.col("n_regionkey") == F.col("r_regionkey")))
    key = "master_bill_internal_id"
    pickup = (d.lineitem.select("l_orderkey", "l_suppkey")
              .join(d.supplier.select("s_suppkey", "s_name", "s_nationkey"),
                    F.col("l_suppkey") == F.col("s_suppkey"))
              .join(geo, F.col("s_nationkey") == F.col("n_nationkey"))
              .select(F.col("l_orderkey").alias(key), F.lit("Pickup").alias("event_type"),
                      F.col("s_name").alias("city"), F.col("n_name").alias("state"),
                      F.col("r_name").alias("country_code"),
                      F.col("s_suppkey").cast("string").alias("postal_code")))
    drop = (d.orders.select("o_orderkey", "o_custkey")
            .join(d.customer.select("c_custkey", "c_name", "c_acctbal", "c_nationkey"),
                  F.col("o_custkey") == F.col("c_custkey"))
            .join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("o_orderkey").alias(key), F.lit("Drop").alias("event_type"),
                    F.when(F.col("c_acctbal") < 0, None).otherwise(F.col("c_name")).alias("city"),
                    F.col("n_name").alias("state"), F.col("r_name").alias("country_code"),
                    F.col("c_custkey").cast("string").alias("postal_code")))
    null_s = F.lit(None).cast("string")
    booked = (d.orders.filter(F.col("o_orderpriority") == "5-LOW")
              .select(F.col("o_orderkey").alias(key), F.lit("Booked").alias("event_type"),
                      null_s.alias("city"), null_s.alias("state"),
                      null_s.alias("country_code"), null_s.alias("postal_code")))
    return pickup.unionByName(drop).unionByName(booked)


def fact_load(d: DriverTables) -> DataFrame:
    """One load per order and line status, so none for orders without lines."""
    li = d.lineitem.select("l_orderkey", "l_linestatus").distinct()
    o = d.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    c = d.customer.select("c_custkey", "c_mktsegment")
    load = F.col("o_orderkey") * 10 + (F.col("l_linestatus") == "O").cast("long")
    return (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
            .select(F.col("o_orderkey").alias(ID), load.alias("load_id"),
                    F.col("o_orderpriority").alias("carrier_name"),
                    F.col("c_mktsegment").alias("mode")))


VIEWS = {
    "masterbill": masterbill,
    "activity": activity,
    "carrier": carrier,
    "item_dimension": item_dimension,
    "item_weight": item_weight,
    "itemgroup_line_item": itemgroup_line_item,
    "item_group": item_group,
    "masterbill_margins": masterbill_margins,
    "tracking_shipment_status": tracking_shipment_status,
    "event": event,
    "fact_load": fact_load,
}
