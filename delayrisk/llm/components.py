"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

PART = 1 << 17  # rows of a staged part, about


def few_parts(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` short rows, in parts by their number: else a shuffle's every part would be a small file."""
    return df.coalesce(max(1, -(-rows // PART)))


def _heads(nb: DataFrame) -> DataFrame:
    """The smallest of each node and its neighbours, joined back to the node's links.

    A minimum per node combines before the shuffle, and the join back can be
    split when one node holds many links, so no node's links meet in one task.
    """
    low = nb.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return nb.join(low, "u")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (columns u, v, any ordered type, both not null).

    ``root`` is the smallest node that can be reached.  Each round turns
    links toward ever smaller nodes; link tables are staged, and only a count
    and a checksum reach the driver to tell when nothing changes any more.
    """
    now = stage(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                .distinct(), "links")
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _heads(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _heads(large.filter("u <> v"))
        star = (small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        # A round at most doubles its links.
        now = stage(few_parts(star, 2 * mark[0]), "links")
    raise RuntimeError(f"links still change after {rounds} rounds")
