"""Table writes.

Plain Spark tables have no MERGE and ignore ``mergeSchema`` on overwrite
(ledger L14), so every write is "build the new contents whole, then show them".
A written name is a view, the pointer, over a version table of its own.  New rows go to a new version;
one catalog statement moves the pointer.  Readers therefore find the old or the new
rows at any time, and a job that resolved the name before the move reads on from the
version it found, which is dropped only by the write after next.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import stage


def _exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def _write_new(df: DataFrame, name: str, bucket_by: Sequence[str] | None = None,
               buckets: int | None = None) -> None:
    """Write ``df`` to a table that does not exist yet."""
    w = df.write.mode("errorifexists")
    if bucket_by:
        n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        w = w.bucketBy(n, *bucket_by).sortBy(*bucket_by)
    w.saveAsTable(name)


def _versions(spark: SparkSession, name: str) -> list[str]:
    """The version tables of ``name``, oldest first; a version is listed only once its rows are complete."""
    *db, table = name.split(".")
    place = f" IN {'.'.join(db)}" if db else ""
    shown = [r["tableName"] for r in spark.sql(f"SHOW TABLES{place} LIKE '{table}_v_*'").collect()]
    mine = sorted(t for t in shown if re.fullmatch(rf"{re.escape(table.lower())}_v_\d{{20}}_[0-9a-f]{{8}}", t))
    return [".".join([*db, t]) for t in mine]


def _new_version(name: str, at: int | None = None) -> str:
    return f"{name}_v_{time.time_ns() if at is None else at:020d}_{uuid.uuid4().hex[:8]}"


def _pointer(spark: SparkSession, name: str) -> str | None:
    """What the view ``name`` selects from; None if it is a plain table."""
    for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect():
        if r["col_name"] == "View Text":
            return r["data_type"].rpartition(" ")[2]
    return None


def _point(spark: SparkSession, name: str, version: str) -> None:
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {version}")


def recover(spark: SparkSession, name: str) -> None:
    """Bring back a name that a stopped write left without rows to show.

    That can be only where a plain table, not yet behind a pointer, was being replaced: its rows are a version then, and so are the new ones.
    """
    if not _exists(spark, name):
        found = _versions(spark, name)
        if found:
            _point(spark, name, found[-1])


def read(spark: SparkSession, name: str) -> DataFrame:
    """The rows of ``name``, also after a write that stopped."""
    recover(spark, name)
    return spark.table(name)


def replace(df: DataFrame, name: str, **layout) -> None:
    """Show ``df``, which may read ``name``, as the rows of ``name``.

    Whatever step fails, ``name`` shows the old or the new rows whole.  The version shown before stays for those who read it.
    """
    spark = df.sparkSession
    recover(spark, name)
    version = _new_version(name)
    try:
        _write_new(df, version, **layout)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {version}")
        raise
    before = _pointer(spark, name) if _exists(spark, name) else None
    if before is None and _exists(spark, name):
        # A plain table, written by others: from now on it is the oldest version.
        before = _new_version(name, 0)
        spark.sql(f"ALTER TABLE {name} RENAME TO {before}")
    _point(spark, name, version)
    for v in _versions(spark, name):
        if v not in (version.lower(), str(before).lower()):
            spark.sql(f"DROP TABLE IF EXISTS {v}")


def overwrite(df: DataFrame, name: str, bucket_by: Sequence[str] | None = None,
              buckets: int | None = None) -> None:
    """Replace the table's rows and schema; the old table stays until the new one is complete.

    ``bucket_by`` stores the rows bucketed (and sorted) by the key, so later
    joins and merges on that key read co-partitioned files and skip a
    shuffle.  A bucket is one task, so it suits keys of few rows each only.
    """
    replace(df, name, bucket_by=bucket_by, buckets=buckets)


def grow_schema(df: DataFrame, old: T.StructType) -> DataFrame:
    """The old table's columns first (as nulls where ``df`` lacks them), then the new ones.

    A column that both have must keep its type.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    changed = [f.name for f in old.fields if f.name in kinds and kinds[f.name] != f.dataType]
    if changed:
        raise ValueError(f"columns change their type: {changed}")
    kept = [F.col(f.name) if f.name in kinds else F.lit(None).cast(f.dataType).alias(f.name) for f in old.fields]
    return df.select(*kept, *[c for c in df.columns if c not in set(old.names)])


def overwrite_growing(df: DataFrame, name: str) -> None:
    """Overwrite, keeping the table's columns (null where the new rows lack them)."""
    spark = df.sparkSession
    recover(spark, name)
    if _exists(spark, name):
        df = grow_schema(df, spark.table(name).schema)
    replace(df, name)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, or are null (a partial aggregate)."""
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .filter((F.col("n") > 1) | null_key))


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Fail if ``keys`` is not a primary key of ``df`` (one small job)."""
    bad = duplicate_keys(df, keys).limit(1).collect()
    if bad:
        raise ValueError(f"{list(keys)} is not a key: {bad[0].asDict()}")


def create_keyed(df: DataFrame, name: str, keys: Sequence[str], bucketed: bool = True) -> None:
    """Write a table whose ``keys`` are checked to be unique and non-null."""
    assert_unique(df, keys)
    overwrite(df, name, bucket_by=list(keys) if bucketed else None)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new``, plus rows of ``old`` whose key is not in ``new``.

    Every old row of a key that appears in ``new`` is replaced; rows with a
    null key never match, so old ones are kept.  One anti join: Spark
    broadcasts ``new`` only when its measured size is under the broadcast
    threshold, otherwise both sides are shuffled (or read bucketed) by key.
    """
    return new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti"))


def merge_into(new: DataFrame, name: str, keys: Sequence[str], bucketed: bool = True) -> None:
    """Keyed merge write of ``new`` into table ``name`` (created if absent).

    ``keys`` must be unique and non-null in ``new``, so the table's key holds
    after every merge.
    """
    spark = new.sparkSession
    recover(spark, name)
    new = stage(new, "merge")  # the rows that are checked are the rows that are written
    assert_unique(new, keys)
    rows = upsert(spark.table(name), new, keys) if _exists(spark, name) else new
    overwrite(rows, name, bucket_by=list(keys) if bucketed else None)
