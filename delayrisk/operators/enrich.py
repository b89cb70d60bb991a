"""Enrichment of scored shipments: risk level, loads, places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ID
from ..functions.risk import risk_level
from .joins import left_join_fanout

EVENT_KEY = "master_bill_internal_id"
# Fixed values of the reference: event types that name the two ends of a trip,
# and the column each becomes.
ENDS = (("Pickup", "Source"), ("Drop", "Destination"))
PLACE_PARTS = ("city", "state", "country_code", "postal_code")


def with_risk_level(df: DataFrame, contiguous: bool = False) -> DataFrame:
    """P12 on the ``risk_factor`` column."""
    return df.withColumn("risk_level", risk_level(F.col("risk_factor"), contiguous))


def enrich_loads(df: DataFrame, fact_load: DataFrame, keys: DataFrame | None = None,
                 null_keys: bool = True) -> DataFrame:
    """Add load id, carrier and mode; an id with k loads gives k rows.

    Loads fan out per shipment and one shipment may own a large share of
    them, so the left join is written as matched + unmatched parts that AQE
    can balance (``joins.left_join_fanout``); ``keys`` may name a cheap
    frame covering ``df``'s ids, such as the id spine, and ``null_keys=False``
    tells it that ``df`` has no null id.
    """
    loads = fact_load.select(ID, "load_id", "carrier_name", "mode")
    return left_join_fanout(df, loads, ID, keys, null_keys)


def pick_drop_events(events: DataFrame) -> DataFrame:
    """P7 + P13: pickup and drop events with one place text each.

    ``concat_ws`` skips null parts, so an event with no parts has '' (L16).
    """
    kinds = [k for k, _ in ENDS]
    return (events.filter(F.col("event_type").isin(*kinds))
            .select(EVENT_KEY, "event_type",
                    F.concat_ws(", ", *[F.col(c) for c in PLACE_PARTS]).alias("location")))


def locations(events: DataFrame, null_empty: bool = False) -> DataFrame:
    """A5: one row per shipment with its Source and Destination place.

    A pivot over two fixed event types, written as one conditional
    aggregate (single exchange); the pick rule is the smallest place text,
    which does not depend on row order (L2).  ``null_empty`` turns '' into
    null before picking.
    """
    ev = pick_drop_events(events)
    loc = F.col("location")
    if null_empty:
        loc = F.when(loc == "", None).otherwise(loc)
    return ev.groupBy(EVENT_KEY).agg(
        *[F.min(F.when(F.col("event_type") == kind, loc)).alias(name) for kind, name in ENDS])


def enrich_locations(df: DataFrame, loc: DataFrame) -> DataFrame:
    """Left join on the differently named key, then drop that key."""
    return df.join(loc, df[ID] == loc[EVENT_KEY], "left").drop(EVENT_KEY)
