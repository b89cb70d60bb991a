"""Missing-value fills."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ID
from ..functions.draws import coin, uniform
from ..staging import stage
from .stats import quantile

# Fixed values of the reference: the two words drawn for a missing item
# description, and the range of a drawn missing weight.
DESCRIPTION_CHOICES = ("MEDICAL MATERIAL", "Euro Pallet")
WEIGHT_RANGE = (1.0, 2.0)


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Per-column constant for null (and NaN) cells."""
    return df.fillna(dict(values))


def category_fill(col: str, choices=DESCRIPTION_CHOICES, salt: str = "description",
                  key: str = ID, seed: int | None = None) -> Column:
    """I3 as a Column: a missing category becomes one of two words, 50/50 by a per-id draw.

    With ``seed`` the draw is ``rand(seed)``, which follows the partitioning (L4).
    """
    first, second = choices
    heads = coin(salt, key) if seed is None else F.rand(seed) < 0.5
    pick = F.when(heads, F.lit(first)).otherwise(F.lit(second))
    return F.when(F.col(col).isNull(), pick).otherwise(F.col(col))


def uniform_fill(col: str, lo: float = WEIGHT_RANGE[0], hi: float = WEIGHT_RANGE[1],
                 salt: str = "weight", places: int = 3, key: str = ID, seed: int | None = None) -> Column:
    """I4 as a Column: a missing (null or NaN) number becomes a per-id draw in [lo, hi], rounded;
    with ``seed``, of ``rand(seed)``."""
    u = uniform(salt, key, 10 ** places) if seed is None else F.rand(seed)
    v = F.round(F.lit(lo) + u * F.lit(hi - lo), places)
    c = F.col(col)
    return F.when(c.isNull() | F.isnan(c), v).otherwise(c)


def constant_fill(col: str, value: float) -> Column:
    """I2 as a Column for a numeric column: null or NaN becomes ``value``."""
    c = F.col(col)
    return F.when(c.isNull() | F.isnan(c), F.lit(value)).otherwise(c)


def fill_category(df: DataFrame, col: str, choices=DESCRIPTION_CHOICES,
                  salt: str = "description", key: str = ID, seed: int | None = None) -> DataFrame:
    """I3 on a frame."""
    return df.withColumn(col, category_fill(col, choices, salt, key, seed))


def fill_uniform(df: DataFrame, col: str, lo: float = WEIGHT_RANGE[0], hi: float = WEIGHT_RANGE[1],
                 salt: str = "weight", places: int = 3, key: str = ID, seed: int | None = None) -> DataFrame:
    """I4 on a frame."""
    return df.withColumn(col, uniform_fill(col, lo, hi, salt, places, key, seed))


def fill_median(df: DataFrame, col: str, error: float = 0.01) -> DataFrame:
    """I5 (+A11): missing values of ``col`` become its median.

    ``error`` is the relative rank error of Spark's quantile sketch; with
    ``error=0`` the exact lower median is found by distributed histogram
    refinement (``stats.quantile``), never by pulling the column to one task.
    The passes read ``df`` from a staged copy, so its plan runs once.
    """
    if error == 0:
        df = stage(df, "median")
    m = quantile(df, col, 0.5, error)
    return df if m is None else df.fillna({col: m})
