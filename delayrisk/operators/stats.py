"""Quantiles of a numeric column.

``error > 0`` uses Spark's mergeable quantile sketch (``approxQuantile``),
as the reference does.  ``error == 0`` (and ``quantiles``) finds the exact
order statistics at 0-based ranks ``floor((n - 1) * q)`` with two scans of the
column.  The first builds the sketch, whose rank error is bounded, so that two of its
answers enclose each wanted rank.  The second counts what lies between those
enclosures and keeps, as distinct values with counts, what lies inside; that small table is
staged, and only where it has more than ``PICKED`` rows a histogram narrows it
further.  At most ``PICKED`` rows reach the driver, and no task holds more than
its own partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage

BUCKETS = 4096
ACCURACY = 2000  # of the sketch: ranks are off by at most n / ACCURACY
PICKED = 65536


def _values(df: DataFrame, col: str) -> DataFrame:
    v = F.col(col).cast("double")
    return df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))


def quantile(df: DataFrame, col: str, q: float, error: float = 0.01,
             buckets: int = BUCKETS, picked: int = PICKED) -> float | None:
    """The ``q`` quantile of the non-null, non-NaN values of ``col``; None if empty."""
    if error > 0:
        r = _values(df, col).approxQuantile("v", [q], error)
        return r[0] if r else None
    found = quantiles(df, col, [q], buckets, picked)
    return found[0] if found else None


def quantiles(df: DataFrame, col: str, qs: Sequence[float], buckets: int = BUCKETS, picked: int = PICKED) -> list[float]:
    """Exact quantiles of the non-null, non-NaN values of ``col``, in the order of ``qs``; none if it has no values."""
    vals = _values(df, col)
    margin = 2 / ACCURACY
    asked = [min(max(q + side, 0.0), 1.0) for q in qs for side in (-margin, margin)]
    head = vals.agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"),
                    F.percentile_approx("v", F.array(*[F.lit(p) for p in asked]), F.lit(ACCURACY)).alias("p")).first()
    n = head["n"]
    if not n:
        return []
    # At either end the sketch has no room for its error, so the extremes enclose.
    around = sorted((head["low"] if asked[k] <= margin else head["p"][k], head["high"] if asked[k + 1] >= 1 - margin else head["p"][k + 1])
                    for k in range(0, len(asked), 2))
    spans: list[list[float]] = []
    for low, high in around:
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    # Span k has the values of place k that are kept; those of place k that lie below it are only counted.
    place = sum((F.when(F.col("v") > high, 1).otherwise(0) for _, high in spans), F.lit(0))
    inside = F.when(_any(F.col("v").between(low, high) for low, high in spans), F.col("v"))
    kept = stage(vals.groupBy(place.alias("place"), inside.alias("v")).agg(F.count("*").alias("n")), "quantiles")
    ranks = [int(math.floor((n - 1) * q)) for q in qs]
    if kept.count() <= picked:
        out, before, wanted = {}, 0, sorted(set(ranks))
        for r in kept.orderBy("place", F.col("v").asc_nulls_first()).collect():
            before += r["n"]
            while wanted and wanted[0] < before:
                out[wanted.pop(0)] = r["v"]
        return [out[r] for r in ranks]
    sums = {r["place"]: (r["less"], r["n"]) for r in kept.groupBy("place").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("less")).collect()}
    out = []
    for rank in ranks:
        before = 0
        for k in sorted(sums):
            if rank < before + sums[k][1]:
                low, high = spans[k]
                out.append(_narrowed(kept.filter((F.col("place") == k) & F.col("v").isNotNull()), rank - before - sums[k][0], low, high, buckets))
                break
            before += sums[k][1]
    return out


def _any(tests):
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _narrowed(counts: DataFrame, rank: int, lo: float, hi: float, buckets: int = BUCKETS) -> float:
    """The value at ``rank`` of the values with counts (v, n), all between ``lo`` and ``hi``."""
    while lo < hi:
        # Halves keep the width finite for any pair of doubles.
        half = hi / 2 - lo / 2
        if not half > 0:  # adjacent subnormals: nothing lies between lo and hi
            at_lo = counts.filter(F.col("v") == lo).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            return lo if rank < at_lo else hi
        pos = (F.col("v") / 2 - F.lit(lo / 2)) / F.lit(half) * buckets
        b = F.least(F.greatest(F.floor(pos), F.lit(0)).cast("int"), F.lit(buckets - 1))
        hist = (counts.filter(F.col("v").between(lo, hi)).groupBy(b.alias("b"))
                .agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                .orderBy("b").collect())
        before = (lo, hi)
        for row in hist:
            if rank < row["n"]:
                lo, hi = row["lo"], row["hi"]
                break
            rank -= row["n"]
        if (lo, hi) == before and len(hist) > 1:  # cannot happen with lo, hi in different buckets
            raise RuntimeError(f"quantile refinement stalled on [{lo}, {hi}]")
    return lo
