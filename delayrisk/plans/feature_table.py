"""Build the per-shipment feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bag, impute


#: What missing distances, volumes and margins become.
FILLS = {"distance_km": 0.0, "volume_cm3": 0.0, "margin_value": 0.0}


def fill_features(rows: DataFrame) -> DataFrame:
    """The reference's fills, in its order, then the description is dropped.

    The reference fills the description and drops it right after, so that
    fill has no effect on the rows and is left out.  The numeric fills
    are one projection: distance 0, weight drawn per id, volume 0, NaN margin 0.
    """
    # Null margins have their default already; a NaN would stop the model.
    fills = {c: impute.constant_fill(c, v) for c, v in FILLS.items()}
    fills["total_weight"] = impute.uniform_fill("total_weight")
    return rows.select(*[fills[c].alias(c) if c in fills else F.col(c)
                        for c in rows.columns if c != "item_description"])


def feature_table(tables, dedupe: bool = False) -> DataFrame:
    """Features of every shipment.

    ``dedupe=False`` keeps the reference's rows: one per distinct
    (distance, margin, description) combination of an id, with the
    description dropped at the end, so an id can repeat (ledger L5).
    ``dedupe=True`` keeps one row per distinct feature tuple, which is what
    training and scoring want; those rows do not depend on the description
    (every fill is per id), so that part is not built at all.  The sets are
    filled before they are folded, so the combinations of an id are distinct
    as they are made, and no deduplication has to follow.
    """
    return fill_features(bag.expand(bag.factorised(tables, described=not dedupe, fills=FILLS if dedupe else None)))
