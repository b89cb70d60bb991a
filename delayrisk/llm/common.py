"""Helpers shared by the operators: shipping modules, column handling; staging comes from the library."""

from __future__ import annotations

import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from ..session import bound_batches
from ..staging import fresh, global_rank, scratch, stage, width

__all__ = ["WORD", "arrow_map", "fresh", "global_rank", "plain_keys", "scratch", "ship", "stage", "table",
           "text_or_empty", "width"]

#: Words of a text: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give executors this package's modules (once per context), so that tasks
    import them and keep what they cache for as long as their worker lives."""
    sc = spark.sparkContext
    if getattr(sc, "_delayrisk_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # Made and read by the driver alone, which serves it to the executors.
    path = os.path.join(tempfile.mkdtemp(prefix="delayrisk-ship-"), "delayrisk_modules.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._delayrisk_shipped = True


def arrow_map(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with this package's modules at hand on the executors.

    Rows that carry texts come in batches bounded by bytes, and a worker gives what Arrow kept back at its task's end:
    it lives on, idle or not, while later stages need the memory.
    """
    ship(df.sparkSession)
    if any(isinstance(f.dataType, (StringType, BinaryType)) for f in df.schema):
        bound_batches(df.sparkSession)

    def apply(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
    return df.mapInArrow(apply, schema)


def plain_keys(df: DataFrame, cols: list[str], names: list[str]) -> DataFrame:
    """Add two columns per column of ``cols`` (its null flag, and its value with nulls filled) so
    that plain equality joins rows null-safely and keeps the partitioning; ``names`` has the new names."""
    for c, (flag, value) in zip(cols, zip(names[::2], names[1::2])):
        kind = df.schema[c].dataType
        df = df.withColumn(flag, F.col(c).isNull()).withColumn(value, F.coalesce(c, F.lit("0").cast(kind)))
    return df


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
