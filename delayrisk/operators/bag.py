"""The feature bag kept in factors.

The joined feature rows of an id are all combinations of its distances, margins and descriptions, so
an id with a thousand distances and ten thousand descriptions has ten million rows.  Kept in factors it is one row
of single values and set sizes (``ids``) and one row per value (``values``).  Row counts, null
counts, the number of ids and the median of a column follow from these with weights; ``expand`` makes the combinations when
rows are wanted, as its last step.

Three exchanges build it: one folds the values of all three sets together, one the single values, one the set sizes.
All are partial aggregates, so a hot id costs a row per task and value.  ``expand`` collects the sets of an id into arrays only up to
``WIDE`` values each; ids with more are expanded by joins, which AQE splits on either side.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ID
from ..staging import stage
from . import features as feat
from .stats import BUCKETS, _narrowed

WIDE = 1024

DISTANCE, MARGIN, TEXT = "distance", "margin", "text"


@dataclass(frozen=True)
class Bag:
    """``ids``: one row per spine id; ``values``: one row per id, kind and value; both staged."""
    ids: DataFrame
    values: DataFrame
    described: bool


def _values(t, described: bool, fills: Mapping[str, float]) -> DataFrame:
    """(id, kind, num, text, grp, line, flag): every value of each set once; line items bring the hazard flag along."""
    def filled(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.when(v.isNull() | F.isnan(v), F.lit(fills[c])).otherwise(v) if c in fills else v
    num, text, no = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(False)
    off = F.lit(None).cast("boolean")

    def rows(df: DataFrame, kind: str, n: Column = num, s: Column = text, grp: Column = no, line: Column = no, flag: Column = off) -> DataFrame:
        return df.select(ID, F.lit(kind).alias("kind"), n.alias("num"), s.alias("text"), grp.alias("grp"), line.alias("line"), flag.alias("flag"))
    lines = t["itemgroup_line_item"]
    margins = t["masterbill_margins"].filter(F.col("margin_type") == "CurrentMargin")
    every = (rows(t["carrier"], DISTANCE, filled("distance_km"))
             # A missing margin counts as 0, also beside a margin of 0.
             .unionByName(rows(margins, MARGIN, F.coalesce(filled("margin_value"), F.lit(0.0))))
             .unionByName(rows(lines, TEXT, s=F.col("description") if described else text, line=F.lit(True),
                               flag=feat.hazard_text(F.col("hazardous_material_flag")))))
    if described:
        every = every.unionByName(rows(t["item_group"], TEXT, s=F.col("description"), grp=F.lit(True)))
    # A null id joins nothing.
    return (every.filter(F.col(ID).isNotNull()).groupBy(ID, "kind", "num", "text")
            .agg(F.bool_or("grp").alias("grp"), F.bool_or("line").alias("line"), F.bool_or("flag").alias("flag")))


def _single(t) -> DataFrame:
    """Volume and weight of every spine id, from one aggregate over the three tables."""
    none = F.lit(None).cast("double")
    sides = feat.convert_unit(t["item_dimension"])
    one = {s: F.when(F.col("dimension_dim") == s, F.col("dimension_cm")) for s in feat.SIDES}
    weights = t["item_weight"].filter(F.col("weight_type") == "actual")
    every = (t["masterbill"].select(ID, F.lit(True).alias("spine"), *[none.alias(s) for s in feat.SIDES], none.alias("weight"))
             .unionByName(sides.select(ID, F.lit(False).alias("spine"), *[c.alias(s) for s, c in one.items()], none.alias("weight")))
             .unionByName(weights.select(ID, F.lit(False).alias("spine"), *[none.alias(s) for s in feat.SIDES],
                                         F.col("weight").cast("double").alias("weight"))))
    out = every.groupBy(ID).agg(F.bool_or("spine").alias("spine"), *[F.min(s).alias(s) for s in feat.SIDES], F.sum("weight").alias("total_weight"))
    known = F.col(ID).isNotNull()
    return out.filter("spine").select(
        ID, F.when(known, feat.volume(*[F.col(s) for s in feat.SIDES])).alias("volume_cm3"),
        F.when(known, F.col("total_weight")).alias("total_weight"))


def _sizes(values: DataFrame) -> DataFrame:
    """Per id the sizes of its sets and which of them hold a null.

    Descriptions come from the group table, else from the lines; where the group side holds a null and lines exist, the lines' join it.
    """
    kind, text = F.col("kind"), F.col("text")
    some = kind == TEXT
    has = (values.groupBy(ID).agg(
        F.bool_or("flag").alias("flag"), F.count_if(kind == DISTANCE).alias("distances"),
        F.bool_or((kind == DISTANCE) & F.col("num").isNull()).alias("distance_null"), F.count_if(kind == MARGIN).alias("margins"),
        F.bool_or("grp").alias("has_grp"), F.bool_or("line").alias("has_line"),
        F.bool_or(F.col("grp") & text.isNull()).alias("grp_null"), F.bool_or(F.col("line") & text.isNull()).alias("line_null"),
        F.count_if(some & F.col("grp") & text.isNotNull()).alias("g"), F.count_if(some & F.col("line")).alias("l"),
        F.count_if(some & F.col("grp") & F.col("line") & text.isNotNull()).alias("both")))
    texts = (F.when(~F.col("has_grp"), F.col("l")).when(~F.col("has_line"), F.col("g") + F.col("grp_null").cast("int"))
             .when(F.col("grp_null"), F.col("g") + F.col("l") - F.col("both")).otherwise(F.col("g")))
    null_text = F.when(~F.col("has_grp"), F.col("line_null")).when(~F.col("has_line"), F.col("grp_null")).otherwise(
        F.col("grp_null") & F.col("line_null"))
    return has.select(ID, "flag", "distances", "distance_null", "margins", "has_grp", "has_line", "grp_null",
                      texts.alias("texts"), null_text.alias("text_null"))


def factorised(t, described: bool = True, fills: Mapping[str, float] | None = None) -> Bag:
    """The bag of a ``Tables`` resolver; each input is scanned once.

    ``fills`` names values for the missing distances and margins (null or NaN) that the inputs hold; a set
    folds them with its own such value, so ids' combinations stay distinct after that fill.
    """
    values = stage(_values(t, described, fills or {}), "values")
    sizes = _sizes(values)
    rows = _single(t).join(sizes, ID, "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    yes = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    rows = rows.select(ID, "volume_cm3", "total_weight", F.coalesce("flag", F.lit(False)).alias("hazardous_material_flag"),
                       count("distances"), yes("distance_null"), count("margins"), count("texts") if described else F.lit(0).cast("long").alias("texts"),
                       yes("text_null"), yes("has_grp"), yes("has_line"), yes("grp_null"))
    return Bag(stage(rows, "ids"), values, described)


def _times(*sets: str) -> Column:
    """Combinations of the sets' values; an empty set stands for one null."""
    out = F.lit(1).cast("long")
    for s in sets:
        out = out * F.greatest(F.col(s), F.lit(1))
    return out


def row_count(bag: Bag) -> DataFrame:
    return bag.ids.agg(F.coalesce(F.sum(_times("distances", "margins", "texts")), F.lit(0)).alias("rows"))


def null_profile(bag: Bag) -> DataFrame:
    """A6 of the expanded rows, from one pass over the ids; null on an empty bag, as the sum over its rows would be."""
    def total(test: Column, times: Column) -> Column:
        return F.sum(F.when(test, times).otherwise(0))
    all_sets = _times("distances", "margins", "texts")
    counts = {ID: total(F.col(ID).isNull(), all_sets), "volume_cm3": total(F.col("volume_cm3").isNull(), all_sets),
              "distance_km": total((F.col("distances") == 0) | F.col("distance_null"), _times("margins", "texts")),
              "total_weight": total(F.col("total_weight").isNull(), all_sets),
              "hazardous_material_flag": total(F.lit(False), all_sets), "margin_value": total(F.lit(False), all_sets)}
    if bag.described:
        counts["item_description"] = total((F.col("texts") == 0) | F.col("text_null"), _times("distances", "margins"))
    return bag.ids.agg(*[c.cast("long").alias(f"{n}_null_count") for n, c in counts.items()])


def median_distance(bag: Bag, q: float = 0.5, buckets: int = BUCKETS) -> float | None:
    """A11 of the expanded rows' distances: each distance weighs as often as its id repeats it.

    The values are folded to distinct ones with their weights, and only that table is read again.
    """
    known = bag.values.filter((F.col("kind") == DISTANCE) & F.col("num").isNotNull() & ~F.isnan("num"))
    weights = bag.ids.select(ID, _times("margins", "texts").alias("w"))
    counts = stage(known.select(ID, F.col("num").alias("v")).join(weights, ID).groupBy("v").agg(F.sum("w").alias("n")), "weighted")
    head = counts.agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not head["n"]:
        return None
    return _narrowed(counts, int((head["n"] - 1) * q), head["low"], head["high"], buckets)


def fill_median(bag: Bag) -> DataFrame:
    """I5 on the distances: rows are made after their median is known."""
    m = median_distance(bag)
    rows = expand(bag)
    return rows if m is None else rows.fillna({"distance_km": m})


def descriptions(bag: Bag) -> DataFrame:
    """(id, item_description, rows): each description of an id with the number of expanded rows that hold it."""
    flags = bag.ids.select(ID, "texts", "has_grp", "has_line", "grp_null", _times("distances", "margins").alias("rows"))
    kept = (bag.values.filter(F.col("kind") == TEXT).join(flags, ID)
            .filter(_keeps(*[F.col(c) for c in ("grp", "line", "text", "has_grp", "has_line", "grp_null")]))
            .select(ID, F.col("text").alias("item_description"), "rows"))
    none = flags.filter("texts = 0").select(ID, F.lit(None).cast("string").alias("item_description"), "rows")
    return kept.unionByName(none)


def repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column ``times`` says."""
    return rows.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).drop(times)


def _keeps(grp: Column, line: Column, text: Column, has_grp: Column, has_line: Column, grp_null: Column) -> Column:
    return (grp & (text.isNotNull() | ~has_line)) | (line & (~has_grp | grp_null))


def _columns(bag: Bag, distance: Column, margin: Column, text: Column) -> list[Column]:
    cols = [F.col(ID), F.col("volume_cm3"), distance.alias("distance_km"), F.col("total_weight"), F.col("hazardous_material_flag"),
            F.coalesce(margin, F.lit(0.0)).alias("margin_value")]
    return cols + [text.alias("item_description")] if bag.described else cols


def _narrow(bag: Bag, ids: DataFrame, values: DataFrame) -> DataFrame:
    kind = F.col("kind")
    # Dealt by id first: the arrays are built where they are used, and values travel once, not as arrays of a few.
    sets = values.repartition(ID).groupBy(ID).agg(
        F.collect_list(F.when(kind == DISTANCE, F.struct("num"))).alias("d"), F.collect_list(F.when(kind == MARGIN, F.struct("num"))).alias("m"),
        F.collect_list(F.when(kind == TEXT, F.struct("text", "grp", "line"))).alias("t"))
    flags = [F.col(c) for c in ("has_grp", "has_line", "grp_null")]
    kept = F.filter("t", lambda x: _keeps(x["grp"], x["line"], x["text"], *flags))
    rows = ids.join(sets, ID, "left").withColumn("t", kept if bag.described else F.lit(None).cast("array<struct<text:string>>"))
    for c in "dmt" if bag.described else "dm":
        rows = rows.withColumn(c, F.explode_outer(c))
    return rows.select(*_columns(bag, F.col("d.num"), F.col("m.num"), F.col("t.text")))


def _wide(bag: Bag, ids: DataFrame, values: DataFrame) -> DataFrame:
    """The same by joins; each set gets a null row for ids that have none, so that all joins are inner ones."""
    flags = ids.select(ID, "has_grp", "has_line", "grp_null")
    texts = values.filter(F.col("kind") == TEXT).join(flags, ID).filter(
        _keeps(*[F.col(c) for c in ("grp", "line", "text", "has_grp", "has_line", "grp_null")]))
    sets = {"distances": values.filter(F.col("kind") == DISTANCE).select(ID, F.col("num").alias("d")),
            "margins": values.filter(F.col("kind") == MARGIN).select(ID, F.col("num").alias("m")),
            "texts": texts.select(ID, F.col("text").alias("t"))}
    rows = ids
    for size, part in sets.items():
        if size == "texts" and not bag.described:
            continue
        pad = ids.filter(F.col(size) == 0).select(ID, F.lit(None).cast(part.schema[1].dataType).alias(part.columns[1]))
        rows = rows.join(part.unionByName(pad), ID)
    return rows.select(*_columns(bag, F.col("d"), F.col("m"), F.col("t") if bag.described else F.lit(None)))


def expand(bag: Bag, wide: int = WIDE) -> DataFrame:
    """All combinations as rows: the reference's joined feature rows, each once."""
    large = F.greatest("distances", "margins", "texts") > wide
    hot = bag.ids.filter(large)
    if hot.limit(1).count() == 0:
        return _narrow(bag, bag.ids, bag.values)
    keys = hot.select(ID)
    return _narrow(bag, bag.ids.filter(~large), bag.values.join(keys, ID, "left_anti")).unionByName(
        _wide(bag, hot, bag.values.join(keys, ID, "left_semi")))
