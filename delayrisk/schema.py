"""Declared schemas of the freight input tables and of the outputs.

The reference declares none; types come from the catalog and code casts
where it needs to.  Here the columns each job reads are declared, and
``check`` verifies a table at the boundary: a missing column fails at once
(before a job is planned), a different type is reported and only fails in
strict mode, because the jobs cast numbers and flags themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

L, D, S, B, TS = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.TimestampNTZType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


ID_F = ("masterbill_internal_id", L)

INPUTS = {
    "masterbill": _schema(ID_F),
    "activity": _schema(ID_F, ("completion_date", TS), ("planned_date", TS)),
    "carrier": _schema(ID_F, ("distance_km", D)),
    "item_dimension": _schema(ID_F, ("dimension_dim", S), ("dimension", D)),
    "item_weight": _schema(ID_F, ("weight_type", S), ("weight", D)),
    "itemgroup_line_item": _schema(ID_F, ("hazardous_material_flag", S), ("description", S)),
    "item_group": _schema(ID_F, ("description", S)),
    "masterbill_margins": _schema(ID_F, ("margin_type", S), ("margin_value", D)),
    "tracking_shipment_status": _schema(ID_F, ("event_type", S)),
    "event": _schema(("master_bill_internal_id", L), ("event_type", S), ("city", S), ("state", S),
                     ("country_code", S), ("postal_code", S)),
    "fact_load": _schema(ID_F, ("load_id", L), ("carrier_name", S), ("mode", S)),
}

OUTPUTS = {
    "feature_masterbill": _schema(ID_F, ("volume_cm3", D), ("distance_km", D),
                                  ("total_weight", D), ("hazardous_material_flag", B),
                                  ("margin_value", D)),
    "delivery_delay_labels": _schema(ID_F, ("delivery_delay", S)),
}


class SchemaError(ValueError):
    pass


def check(df: DataFrame, schema: T.StructType, name: str = "table",
          strict: bool = False) -> list[str]:
    """Missing columns raise; type differences are returned (raised if strict)."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in have]
    if missing:
        raise SchemaError(f"{name}: missing columns {missing}")
    diffs = [f"{name}.{f.name}: {have[f.name].simpleString()} (declared {f.dataType.simpleString()})"
             for f in schema.fields if have[f.name] != f.dataType]
    if diffs and strict:
        raise SchemaError("; ".join(diffs))
    return diffs
