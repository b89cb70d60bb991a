"""Data-quality profile of a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ID


def null_profile(df: DataFrame) -> DataFrame:
    """One row, ``<col>_null_count`` per column, all in one pass.

    ``sum`` (not ``count_if``) keeps the reference's null result on an
    empty frame.
    """
    return df.select([F.sum(F.col(c).isNull().cast("long")).alias(f"{c}_null_count")
                      for c in df.columns])


def unique_ids(df: DataFrame, key: str = ID, name: str = "unique_masterbills") -> DataFrame:
    """Number of distinct ids, a null id counted once (as ``distinct`` does).

    Joined feature rows have exactly the ids of their spine (left joins from
    it add and lose none), so pass the spine to count them without the joins.
    """
    return df.select(key).distinct().agg(F.count(F.lit(1)).alias(name))
