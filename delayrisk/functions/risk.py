"""Risk bands, labels and percent helpers as Column expressions.

The dashboard ran these per row in pandas; here each is a Column -> Column
function that stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference.
# Risk levels by closed band of the risk factor (gaps in between give null):
#   [0, 50] Normal, [51, 70] Low, [71, 90] Medium, [91, 100] High.
BANDS = (("Normal", 0, 50), ("Low", 51, 70), ("Medium", 71, 90), ("High", 91, 100))
# Dashboard categories by label text (trimmed, lower case); anything else is Normal.
HIGH_WORDS = ("high", "high risk", "delayed", "delay", "late")
MEDIUM_WORDS = ("medium", "warning")
LOW_WORDS = ("low", "at risk")
# Percent shown when the risk factor is missing, by label text; else 25.
FALLBACK = ((("high risk", "delayed", "delay", "late"), 95.0),
            (("medium", "warning"), 80.0),
            (("at risk", "low"), 60.0))
FALLBACK_DEFAULT = 25.0
# Colour bands of the percent bar: upper bound (inclusive) -> colour.
COLORS = ((50, "#2ecc71"), (70, "#f1c40f"), (90, "#e67e22"))
COLOR_TOP = "#e74c3c"
# Label shown when a row has no risk level.
NO_LEVEL = "On Time"
# Whitespace that Python's str.strip() removes.
_WS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Text Python's float() accepts: digits with single '_' between them, an
# optional point and exponent, or inf / infinity / nan (any case).
_DIGITS = r"[0-9](?:_?[0-9])*"
FLOAT_TEXT = (rf"^[+-]?(?:(?:(?:{_DIGITS})?\.{_DIGITS}|{_DIGITS}\.?)(?:[eE][+-]?{_DIGITS})?"
              r"|(?i:inf|infinity|nan))$")


def risk_level(c: Column, contiguous: bool = False) -> Column:
    """Level name by band; null outside the bands, in the gaps and for NaN.

    ``contiguous=True`` closes the gaps: each band then runs up to the
    next band's lower bound (L8).
    """
    if contiguous:
        out = F.when((c >= 0) & (c <= 50), "Normal").when((c > 50) & (c <= 70), "Low") \
            .when((c > 70) & (c <= 90), "Medium").when((c > 90) & (c <= 100), "High")
        return F.when(F.isnan(c), F.lit(None).cast("string")).otherwise(out)
    out = None
    for name, lo, hi in BANDS:
        cond = (c >= lo) & (c <= hi)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(F.lit(None).cast("string"))


def clean_text(c: Column) -> Column:
    """``(label or '').strip().lower()``."""
    return F.lower(F.btrim(F.coalesce(c.cast("string"), F.lit("")), F.lit(_WS)))


def norm_risk(label: Column) -> Column:
    """F9 + B7: dashboard category (High/Medium/Low/Normal) of a label."""
    t = clean_text(label)
    return (F.when(t.isin(*HIGH_WORDS), "High").when(t.isin(*MEDIUM_WORDS), "Medium")
            .when(t.isin(*LOW_WORDS), "Low").otherwise("Normal"))


def fallback_percent(label: Column) -> Column:
    """percent for a label when no risk factor is known ('high' gives 25, L15)."""
    t = clean_text(label)
    out = None
    for words, pct in FALLBACK:
        out = F.when(t.isin(*words), pct) if out is None else out.when(t.isin(*words), pct)
    return out.otherwise(FALLBACK_DEFAULT)


def clamp_percent(v: Column) -> Column:
    """Number -> percent clamped to [0, 100]; NaN and null -> null."""
    return (F.when(v.isNull() | F.isnan(v), F.lit(None).cast("double"))
            .when(v < 0, 0.0).when(v > 100, 100.0).otherwise(v))


def to_percent(x: Column, numeric: bool = False) -> Column:
    """number or text -> percent clamped to [0, 100]; bad text, NaN, null -> null.

    Text loses surrounding whitespace, '%' and ',' before it is read as a
    number.  ``numeric=True`` is the path for a numeric column (no text
    round trip), like the app's ``float(x)`` branch.
    """
    if numeric:
        return clamp_percent(x.cast("double"))
    s = F.btrim(x.cast("string"), F.lit(_WS))
    s = F.replace(F.replace(s, F.lit("%"), F.lit("")), F.lit(","), F.lit(""))
    # Read the text the way float() does: '12d' is not a number, '1_0' is 10.
    v = F.when(s.rlike(FLOAT_TEXT), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
    return clamp_percent(v)


def percent_text(p: Column) -> Column:
    """whole percent with half-even rounding, dash for null."""
    v = F.least(F.greatest(p, F.lit(0.0)), F.lit(100.0))
    return F.when(p.isNull(), F.lit("—")).otherwise(
        F.concat(F.bround(v, 0).cast("int").cast("string"), F.lit("%")))


def bar_percent(p: Column) -> Column:
    """Percent drawn on the bar: null or NaN -> 0, clamped to [0, 100]."""
    v = F.when(p.isNull() | F.isnan(p), F.lit(0.0)).otherwise(p)
    return F.when(v < 0, 0.0).when(v > 100, 100.0).otherwise(v)


def color_band(p: Column) -> Column:
    """Bar colour by percent, no gaps (null counts as 0)."""
    v = bar_percent(p)
    out = None
    for hi, color in COLORS:
        out = F.when(v <= hi, color) if out is None else out.when(v <= hi, color)
    return out.otherwise(COLOR_TOP)
