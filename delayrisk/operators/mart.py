"""Dashboard mart: the app's fetch, filters, search, paging and KPIs as Spark queries.

(S2, S3, T1, T2, B1-B8.)  The app fetched 5,000 unordered rows into pandas
and filtered them row by row; here every step is a DataFrame expression,
so the filters run where the data is and only a page or a KPI row comes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import ID
from ..functions import risk as R
from ..staging import fresh, global_rank

# Fixed values of the reference: the mart's columns in display order and the page size.
MART_SCHEMA = T.StructType([
    T.StructField("masterbill_internal_id", T.LongType()),
    T.StructField("volume_cm3", T.DoubleType()),
    T.StructField("distance_km", T.DoubleType()),
    T.StructField("total_weight", T.DoubleType()),
    T.StructField("hazardous_material_flag", T.BooleanType()),
    T.StructField("margin_value", T.DoubleType()),
    T.StructField("delivery_delay", T.StringType()),
    T.StructField("risk_factor", T.DoubleType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("load_id", T.LongType()),
    T.StructField("Source", T.StringType()),
    T.StructField("Destination", T.StringType()),
    T.StructField("carrier_name", T.StringType()),
    T.StructField("mode", T.StringType()),
])
MART_COLS = tuple(f.name for f in MART_SCHEMA.fields)
PAGE_SIZE = 10
# Rows up to which a page is cut from an ordered top-k; deeper pages are ranked.
TOP_ROWS = 10_000
LEVELS = ("Normal", "Low", "Medium", "High")
SEARCH_FIELDS = ("masterbill_internal_id", "Source", "Destination", "carrier_name", "load_id")

# Row order for caps and pages: the reference has none; the id, then the
# load and the remaining columns, make it repeatable.
ORDER = ("masterbill_internal_id", "load_id", "Source", "Destination", "carrier_name", "mode",
         "volume_cm3", "distance_km", "total_weight", "hazardous_material_flag", "margin_value",
         "delivery_delay", "risk_factor", "risk_level")


def conform(df: DataFrame, schema: T.StructType = MART_SCHEMA) -> DataFrame:
    """S3: exactly the schema's columns, in order; absent ones as typed nulls.

    Columns that exist keep their type, so text ids and text percents pass.
    """
    have = set(df.columns)
    return df.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def head_rows(df: DataFrame, cols=MART_COLS, n: int | None = None, order=ORDER) -> DataFrame:
    """S2 + T1: the listed columns of all rows, or of the first ``n`` in a fixed order.

    With ``n`` it is planned as a top-k (each task keeps its best ``n``), never a full sort.
    """
    rows = df.select(*cols)
    return rows if n is None else rows.orderBy(*[c for c in order if c in cols]).limit(n)


def display_columns(df: DataFrame) -> DataFrame:
    """B1 + B2 + B6 + F11: percent, label, category, bar colour and text.

    Two projections: the percent is computed once and then referenced
    (Catalyst keeps a non-cheap expression that is used several times in
    its own projection instead of inlining copies of it).
    """
    rf = F.col("risk_factor")
    numeric = isinstance(df.schema["risk_factor"].dataType, T.NumericType)
    pct = F.coalesce(R.to_percent(rf, numeric), R.fallback_percent(F.col("risk_level")))
    label = F.coalesce(F.col("risk_level"), F.lit(R.NO_LEVEL))
    base = df.select("*", pct.alias("percent"), label.alias("label"))
    p = F.col("percent")
    return base.select("*", R.norm_risk(F.col("label")).alias("category"),
                       R.color_band(p).alias("bar_color"),
                       R.percent_text(R.bar_percent(p)).alias("percent_text"))


def filter_risk(df: DataFrame, levels=()) -> DataFrame:
    """Keep the chosen categories; an empty choice keeps everything."""
    return df.filter(F.col("category").isin(*levels)) if levels else df


def value_text(c: Column, none_text: str = "") -> Column:
    """value as text for searching; null -> ``none_text`` (L11: '' not 'None')."""
    return F.coalesce(c.cast("string"), F.lit(none_text))


def search(df: DataFrame, text: str | None, fields=SEARCH_FIELDS, none_text: str = "") -> DataFrame:
    """B4 + F12: case-free substring search over id, places, carrier and load.

    A plain substring test (``%`` and ``_`` are literal), never ``LIKE``.
    """
    q = (text or "").strip().lower()
    if not q:
        return df
    hay = F.lower(F.concat_ws(" ", *[value_text(F.col(c), none_text) for c in fields]))
    return df.filter(hay.contains(F.lit(q)))


def page_info(df: DataFrame, page: int, size: int = PAGE_SIZE) -> DataFrame:
    """One row (rows, pages, page) with the page clamped to [1, pages]."""
    n = F.count(F.lit(1))
    pages = F.greatest(F.lit(1).cast("long"), F.ceil(n / F.lit(float(size))).cast("long"))
    return df.agg(n.alias("rows"), pages.alias("pages")) \
        .withColumn("page", F.least(F.greatest(F.lit(page).cast("long"), F.lit(1).cast("long")),
                                    F.col("pages")))


def page(df: DataFrame, number: int, size: int = PAGE_SIZE, order=ORDER) -> DataFrame:
    """B5 + T2: rows of one page, the page clamped to [1, pages], in the fixed order.

    Pages that end within ``TOP_ROWS`` rows are cut from an ordered
    top-(number * size) in one lazy plan: each task keeps at most that many
    rows, and the small windows run on those.  If fewer rows exist, their
    count decides the last page; otherwise the page exists as asked.  A
    deeper page is cut by position from the rows dealt by range (each part
    counted, no window over all rows), which the caller's repeated reads of
    deep pages can avoid with ``page_after``.
    """
    from pyspark.sql import Window

    number = max(1, number)
    order = [c for c in order if c in df.columns]
    if number * size > TOP_ROWS:
        ranked = global_rank(df, [F.col(c) for c in order], "_rank")
        last = max(1, -(-ranked.count() // size))
        start = (min(number, last) - 1) * size
        return (ranked.filter((F.col("_rank") >= start) & (F.col("_rank") < start + size))
                .select(*df.columns))
    top = df.orderBy(*order).limit(number * size)
    w = Window.orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    last = F.greatest(F.lit(1), F.ceil(n / F.lit(float(size))))
    shown = F.least(F.lit(number).cast("long"), last.cast("long"))
    ranked = top.select("*", F.row_number().over(w).alias("_rn"), shown.alias("_page"))
    return (ranked.filter((F.col("_rn") > (F.col("_page") - 1) * size)
                          & (F.col("_rn") <= F.col("_page") * size))
            .drop("_rn", "_page"))


def at_or_after(df: DataFrame, last, order) -> Column:
    """Whether a row's ``order`` values are those of ``last`` or come later (ascending, nulls first)."""
    result = F.lit(True)
    for c in reversed(list(order)):
        v, kind = last[c], df.schema[c].dataType
        if v is None:
            result = F.col(c).isNotNull() | result
        else:
            lit = F.lit(v).cast(kind)
            result = F.coalesce((F.col(c) > lit) | ((F.col(c) == lit) & result), F.lit(False))
    return result


def page_after(df: DataFrame, last=None, seen: int = 1, size: int = PAGE_SIZE, order=ORDER) -> DataFrame:
    """Keyset page: the next ``size`` rows after row ``last`` (any mapping of the order's columns).

    The whole order is compared, null-safe, so rows that share an id with
    ``last`` are not skipped; ``seen`` is how many rows alike ``last`` in
    the whole order have been shown (``cursor`` counts them).  The
    comparison of the leading column reaches the scan, and each task keeps
    its first ``seen + size`` rows, so every page costs the same.  A page that
    ends beyond ``TOP_ROWS`` rows would pass whole through one task, so it is
    cut by position: rows that can be on it are dealt by range.
    """
    order = [c for c in order if c in df.columns]
    rest, skip = (df, 0) if last is None else (df.filter(at_or_after(df, last, order)), seen)
    if skip + size <= TOP_ROWS:
        return rest.orderBy(*order).offset(skip).limit(size)
    rank = fresh(df, "rank")
    ranked = global_rank(_first(rest, order[0], skip + size), [F.col(c) for c in order], rank)
    return ranked.filter((F.col(rank) >= skip) & (F.col(rank) < skip + size)).orderBy(rank).drop(rank)


def _first(df: DataFrame, lead: str, n: int) -> DataFrame:
    """At least the first ``n`` rows in an order led by column ``lead``, nulls first, and few more.

    A quantile sketch proposes the largest value needed; it is used only if the rows up to it, counted, are enough.
    """
    if not isinstance(df.schema[lead].dataType, T.NumericType):
        return df
    v, grid = F.col(lead), 1000
    head = df.agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("known"),
                  F.percentile_approx(v, F.array(*[F.lit(k / grid) for k in range(grid + 1)]), F.lit(10 * grid)).alias("p")).first()
    missing = head["n"] - head["known"]
    if n <= missing:
        return df.filter(v.isNull())
    if n >= head["n"]:
        return df
    # Two steps of the grid above the wanted rank: the sketch is off by a tenth of one.
    high = head["p"][min(grid, (n - missing) * grid // head["known"] + 2)]
    some = df.filter(v.isNull() | (v <= F.lit(high)))
    return some if some.count() >= n else df


def cursor(rows: list, last=None, seen: int = 0, order=ORDER) -> tuple:
    """(last, seen) after a page's collected ``rows``, to ask ``page_after`` for the next."""
    if not rows:
        return last, seen
    order = [c for c in order if c in rows[0].asDict()]
    same = lambda a, b: all(a[c] == b[c] for c in order)
    n = sum(same(r, rows[-1]) for r in rows)
    if last is not None and n == len(rows) and same(last, rows[-1]):
        n += seen
    return rows[-1], n


def kpis(df: DataFrame) -> DataFrame:
    """Headline figures over all rows in one aggregate pass.

    Delayed shipments count the 'Delayed' label and hazardous ones the true
    flag (the app compared both with 1, L13); averages are shown to 1 place.
    """
    return df.agg(
        F.count_if(F.col("delivery_delay") == "Delayed").alias("delayed"),
        F.round(F.avg(F.col("distance_km").cast("double")), 1).alias("avg_distance_km"),
        F.round(F.avg(F.col("total_weight").cast("double")), 1).alias("avg_weight"),
        F.count_if(F.col("hazardous_material_flag")).alias("hazardous"))


def kpi_text(k: DataFrame) -> DataFrame:
    """the KPI row as display text: counts with thousands separators,
    averages with one decimal, a dash when an average is missing."""
    def one_place(c: str) -> Column:
        return F.when(F.col(c).isNull(), F.lit("—")).otherwise(F.format_string("%.1f", F.col(c)))
    return k.select(F.format_number(F.col("delayed"), 0).alias("delayed_text"),
                    one_place("avg_distance_km").alias("avg_distance_text"),
                    one_place("avg_weight").alias("avg_weight_text"),
                    F.col("hazardous").cast("string").alias("hazardous_text"))
