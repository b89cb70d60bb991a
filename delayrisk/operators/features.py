"""Per-shipment feature parts and the join that puts them together.

Every part is keyed by ``masterbill_internal_id``.  Parts that hold one row
per id come out of a group-by, so they are already hash-partitioned by the
id and the left joins that follow need no further exchange on that side.
Parts that hold a *set* of values per id (distance, margin, description)
come out of a ``distinct``: partial aggregation dedups on the map side
before the shuffle, so a hot id costs one row per distinct value per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ID
from ..staging import stage
from .joins import left_join_fanout

# Fixed values of the reference: dimension names that become the volume's
# sides, the unit that is converted, and its factor to centimetres.
SIDES = ("height", "width", "length")
INCH = "inch"
INCH_TO_CM = 2.54


def convert_unit(df: DataFrame, value: str = "dimension", unit: str = "dimension_dim",
                 frm: str = INCH, factor: float = INCH_TO_CM,
                 out: str = "dimension_cm", unit_col: str | None = None) -> DataFrame:
    """``out = value * factor`` where the unit test matches, else ``value``.

    The reference tests the pivot key itself (``dimension_dim == 'inch'``),
    so a converted row can never be a side of the volume (ledger L1).
    ``unit_col`` lets a table with a separate unit column use the rule.
    """
    test = F.col(unit_col or unit) == frm
    v = F.col(value).cast("double")
    return df.withColumn(out, F.when(test, v * factor).otherwise(v))


def pivot_dimensions(dims: DataFrame, value: str = "dimension_cm",
                     key: str = "dimension_dim", sides=SIDES) -> DataFrame:
    """A4: one row per id with a column per side.

    Values are fixed (no discovery job, no failure when a side never occurs)
    and the pick rule is the smallest non-null value, which does not depend
    on row order.  Written as one conditional aggregate per side: that is a
    single partial + final aggregate keyed by the id, where
    ``groupBy().pivot()`` would plan two aggregates and two exchanges.
    """
    return dims.groupBy(ID).agg(*[F.min(F.when(F.col(key) == s, F.col(value))).alias(s)
                                  for s in sides])


def volume(height: Column, width: Column, length: Column) -> Column:
    """P5: product of the three sides; null when any side is missing."""
    return height * width * length


def item_volume(item_dimension: DataFrame) -> DataFrame:
    piv = pivot_dimensions(convert_unit(item_dimension))
    return piv.select(ID, volume(F.col("height"), F.col("width"), F.col("length"))
                      .alias("volume_cm3"))


def distance(carrier: DataFrame) -> DataFrame:
    """The set of distances of each id."""
    return carrier.select(ID, F.col("distance_km").cast("double").alias("distance_km")).distinct()


def total_weight(item_weight: DataFrame, weight_type: str = "actual") -> DataFrame:
    """A1: summed weight of one weight type per id."""
    return (item_weight.filter(F.col("weight_type") == weight_type)
            .groupBy(ID).agg(F.sum(F.col("weight").cast("double")).alias("total_weight")))


def hazard_text(c: Column) -> Column:
    """Text flag -> boolean; text Spark cannot read as a boolean becomes null.

    Already-boolean input passes through unchanged.
    """
    return c.try_cast("boolean")


def hazmat_flag(lines: DataFrame) -> DataFrame:
    """A2: true if any line of the id is flagged; null if no line has a flag."""
    return (lines.groupBy(ID)
            .agg(F.bool_or(hazard_text(F.col("hazardous_material_flag")))
                 .alias("hazardous_material_flag")))


def line_summary(lines: DataFrame) -> DataFrame:
    """One row per (id, description) of the line items, the flag pre-folded.

    Both the hazard flag and the description set come from this, so a caller
    that stages it scans the line-item table once.  ``bool_or`` folds in
    stages, so folding per (id, description) first and per id after gives
    the same flag.
    """
    return (lines.groupBy(ID, "description")
            .agg(F.bool_or(hazard_text(F.col("hazardous_material_flag")))
                 .alias("hazardous_material_flag")))


def current_margin(margins: DataFrame, margin_type: str = "CurrentMargin") -> DataFrame:
    """P6 + D1: the set of current margins of each id."""
    return (margins.filter(F.col("margin_type") == margin_type)
            .select(ID, F.col("margin_value").cast("double").alias("margin_value")).distinct())


def drop_events(status: DataFrame, event_type: str = "Drop") -> DataFrame:
    """P6 + D1: ids with a drop event (at most one row per id).

    Deduplicated on the id alone, so Catalyst knows the part is unique per
    id and drops a left join to it whose columns are never read (J7).
    """
    return (status.filter(F.col("event_type") == event_type).select(ID).distinct()
            .select(ID, F.lit(event_type).alias("event_type")))


def item_description(groups: DataFrame, lines: DataFrame) -> DataFrame:
    """Descriptions of each id from the group table, else from its lines.

    The reference full-outer-joins the two description sets on the id and
    keeps ``coalesce(group_desc, line_desc)``.  Per id that result is:

    * only one side present -> that side's set;
    * both present -> the group side's non-null values, plus the whole line
      side when the group side holds a null.

    The same set is computed here without forming the pairs of the outer
    join: both sides are tagged and deduplicated, three flags are counted
    per id (partial aggregate), and each row is kept or dropped by its id's
    flags.  Rows with a null id never match anything in the outer join, so
    they are all kept.  The tagged rows are staged: each input is scanned
    once, and what reads them again reads the small written set.
    """
    return description_from(description_rows(groups, lines))


def description_rows(groups: DataFrame, lines: DataFrame) -> DataFrame:
    """The distinct (id, description, side) of both inputs, staged."""
    a = groups.select(ID, F.col("description").alias("item_description"), F.lit(True).alias("grp"))
    b = lines.select(ID, F.col("description").alias("item_description"), F.lit(False).alias("grp"))
    return stage(a.unionByName(b).distinct(), "descriptions")


def description_from(tagged: DataFrame) -> DataFrame:
    flags = (tagged.filter(F.col(ID).isNotNull()).groupBy(ID)
             .agg(F.bool_or("grp").alias("has_grp"),
                  F.bool_or(~F.col("grp")).alias("has_line"),
                  F.bool_or(F.col("grp") & F.col("item_description").isNull()).alias("grp_null")))
    # An id without flags is the null id: all its rows stay.
    keep = F.when(F.col("has_grp").isNull(), True) \
        .when(F.col("grp"), F.col("item_description").isNotNull() | ~F.col("has_line")) \
        .otherwise(~F.col("has_grp") | F.col("grp_null"))
    return (tagged.join(flags, ID, "left").filter(keep)
            .select(ID, "item_description").distinct())


def join_parts(spine: DataFrame, parts: list[DataFrame], key: str = ID) -> DataFrame:
    """Left-join each part onto the id spine, in list order."""
    return reduce(lambda acc, p: acc.join(p, key, "left"), parts, spine)


def masterbill_ids(masterbill: DataFrame) -> DataFrame:
    """The distinct id spine."""
    return masterbill.select(ID).distinct()


def feature_parts(t, with_description: bool = True) -> dict[str, DataFrame]:
    """All parts of E1 from a ``Tables`` resolver, by name."""
    lines = t["itemgroup_line_item"]
    parts = {}
    if with_description:
        # Staged: the flag and both uses of the descriptions read written sets.
        lines = stage(line_summary(lines), "lines")
        tagged = description_rows(t["item_group"], lines)
        parts = {"item_description": description_from(tagged),
                 # Every id on either description side has at least one description row.
                 "description_ids": tagged.select(ID)}
    return {
        "distance": distance(t["carrier"]),
        "item_volume": item_volume(t["item_dimension"]),
        "total_weight": total_weight(t["item_weight"]),
        "hazmat_flag": hazmat_flag(lines),
        "margin": current_margin(t["masterbill_margins"]),
        "drop_events": drop_events(t["tracking_shipment_status"]),
        **parts,
    }


FEATURES = ("volume_cm3", "distance_km", "total_weight", "hazardous_material_flag", "margin_value")


def feature_join(t, with_description: bool = True) -> DataFrame:
    """J1 + I1: the reference's joined feature rows, before the fills.

    The drop-event part is joined but never read, and Catalyst removes that
    join.  Rows are the distinct combinations of each id's distance, margin
    and description values (ledger L5); the default hazard flag is false,
    the default margin 0.

    Left joins from the spine on one key commute, so the one-row-per-id
    parts go first and the set-valued parts (which multiply rows) last.  One
    id may hold many distances, margins or descriptions, so these joins are
    ``joins.left_join_fanout``: inner joins that AQE can split on either
    side.  A null id matches no part; it is added once with every part
    column null, as the left joins would give it (L19).

    ``with_description=False`` leaves the description out.  The description
    is dropped after the fills, so for callers that deduplicate the final
    rows it only multiplies rows that are collapsed again; skipping it saves
    two line-item-sized scans and their shuffles.
    """
    p = feature_parts(t, with_description)
    spine = masterbill_ids(t["masterbill"])
    ids = spine.filter(F.col(ID).isNotNull())
    rows = join_parts(ids, [p["item_volume"], p["total_weight"], p["hazmat_flag"], p["drop_events"]])
    for part in ("distance", "margin"):
        rows = left_join_fanout(rows, p[part], ID, keys=ids, null_keys=False)
    if with_description:
        rows = left_join_fanout(rows, p["item_description"], ID, keys=ids, null_keys=False,
                                right_keys=p["description_ids"])
    null_id = spine.filter(F.col(ID).isNull()).select(
        ID, *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name != ID])
    joined = rows.unionByName(null_id)
    cols = [ID, "volume_cm3", "distance_km", "total_weight",
            F.coalesce("hazardous_material_flag", F.lit(False)).alias("hazardous_material_flag"),
            F.coalesce("margin_value", F.lit(0.0)).alias("margin_value")]
    if with_description:
        cols.append("item_description")
    return joined.select(*cols).distinct()
