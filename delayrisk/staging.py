"""Staged tables in the shared folder, and positions in a global order.

The folder is the one ``spark.checkpoint.dir`` names; what is written there
outlives lost executors and is cleared by the folder's owner, as checkpoint
files are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import ensure_checkpoint_dir, shuffle_width


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike ``checkpoint()``, which computes its input twice and keeps rows
    whole, one job writes the rows, and later reads prune columns and push
    filters into the scan.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    name, taken = base, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def width(df: DataFrame) -> int:
    return shuffle_width(df.sparkSession)


def global_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Add the 0-based position of each row in the order of ``order``.

    No window over all rows: rows are dealt by range and sorted, the sorted
    parts are staged with their position inside the part, and only one row
    per part (its size) is summed up to give each part its offset.  Rows that
    tie on ``order`` get neighbouring positions.
    """
    part, at = fresh(df, "part"), fresh(df, "at")
    ranged = df.repartitionByRange(width(df), *order).sortWithinPartitions(*order)
    # monotonically_increasing_id is the part's number in the high 31 bits and
    # the position in the part in the low 33.
    rows = stage(ranged.withColumn(at, F.monotonically_increasing_id())
                 .withColumn(part, F.shiftright(at, 33).cast("int"))
                 .withColumn(at, F.col(at).bitwiseAND((1 << 33) - 1)), "ranked")
    sizes = {r[0]: r[1] for r in rows.groupBy(part).count().collect()}  # a row per part
    offset, total = {}, 0
    for p in sorted(sizes):
        offset[p], total = total, total + sizes[p]
    if not offset:
        return rows.withColumn(rank, F.col(at)).drop(part, at)
    first = fresh(df, "offset")
    starts = df.sparkSession.createDataFrame(list(offset.items()), f"{part} int, {first} long")
    # One row per part, so the broadcast side is bounded by their number.
    return (rows.join(F.broadcast(starts), part)
            .withColumn(rank, F.col(at) + F.col(first)).drop(part, at, first))
