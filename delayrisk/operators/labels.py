"""Delivery-delay labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ID

DELAYED = "Delayed"
ON_TIME = "Not Delayed"


def with_all(df: DataFrame, *cols: str) -> DataFrame:
    """Rows that have a value in each of ``cols``."""
    return df.dropna(how="any", subset=list(cols))


def is_late(done: str = "completion_date", due: str = "planned_date") -> Column:
    """Aggregate: whether a group's last ``done`` is after its last ``due``."""
    return F.max(done) > F.max(due)


def delay_labels(activity: DataFrame) -> DataFrame:
    """One label per shipment, by the last completion and the last plan.

    A row with either date missing says nothing; the two maxima are
    independent of each other, and equal ones count as on time.  The
    comparison is made inside one partial + final aggregate: each executor
    folds its rows per id before the shuffle, so a shipment holding a third
    of all rows still ships one row per map task.
    """
    word = F.when(is_late(), DELAYED).otherwise(ON_TIME)
    return with_all(activity, "completion_date", "planned_date").groupBy(ID).agg(word.alias("delivery_delay"))
