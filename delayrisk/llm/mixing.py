"""Mixing sources to target weights by repetition rates.

Words are totalled per source; targets share the mix by weight, none above
``limit`` times its source's size; each source's repetition rate is target
over size.  A document comes floor(rate) times, plus one copy drawn with
probability equal to the rate's fraction.  The draw is a Bernoulli draw seeded by a
hash of the source; within a source the draws of documents next to each other in size order
are made jointly (systematic sampling: every document still has exactly that
probability), so the words taken stay within about one document of the target
instead of drifting with the square root of the source's size.

Defined cases: a null or empty text has size 0 and takes 0 words; null is a
source of its own, last in order; a source whose texts are all empty has
target 0; equal sizes are ordered by id, then text hash; repeated rows are
documents of their own; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, global_rank, plain_keys, stage

WEIGHTS = (5, 2, 1)


def words(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(t, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5,
            limit: int = 2) -> DataFrame:
    """(source, words) -> the same with ``target``.

    Every round shares out what is left among the sources below their limit;
    those that would exceed it are set to it.  What a round needs from the
    sources are four sums, so only these reach the driver.
    """
    ranked = global_rank(sources, [F.col("source").isNull(), F.col("source")], "place")
    weigh = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = stage(ranked.select("source", "words", weigh.cast("long").alias("weight")), "sources")
    total = rows.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    amount, most = share * total, F.col("words") * limit
    level, unset, before = None, None, -1
    full = F.lit(False)
    while True:
        got = rows.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, most)), F.lit(0)),
                       F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if got[0] == before:
            break
        before, level, unset = got[0], amount - got[1], got[2]
        if not unset:
            break
        # A source is full once its share of what is left reaches its limit;
        # full sources stay full, as what is left per weight only grows.
        full = F.col("weight") * F.lit(level) / F.lit(float(unset)) >= most
    part = F.col("weight") * F.lit(level) / F.lit(float(unset)) if unset else most.cast("double")
    return rows.withColumn("target", F.when(full, most.cast("double")).otherwise(part))


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id",
        weights: Sequence[int] = WEIGHTS, share: float = 1.5, limit: int = 2, seed: int = 5) -> DataFrame:
    """One row per document: id_col, size, source, text hash, source_size, target, copies, taken."""
    sized = stage(docs.select(F.col(id_col).alias("i"), F.col(source).alias("source"), words(text).alias("size"),
                              F.xxhash64(text).alias("h")), "sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("words"))
    rates = stage(targets(by_source, weights, share, limit), "targets")
    # Positions over all documents, by source and size; a source's own start is its smallest.
    placed = global_rank(sized, [F.col("source").isNull(), F.col("source"), F.col("size").desc(),
                                 F.col("i"), F.col("h")], "place")
    starts = placed.groupBy("source").agg(F.min("place").alias("first"))
    rates = rates.join(starts, _same(rates["source"], starts["source"])).select(
        rates["source"].alias("s"), "words", "target", "first")
    joined = placed.join(rates, _same(F.col("source"), F.col("s")))
    rate = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(F.lit(0.0))
    part = F.col("rate") - F.floor("rate")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))))
    # 52 bits of the hash as a start in [0, 1).
    start = F.conv(F.substring(key, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    at = (F.col("place") - F.col("first")).cast("double")
    drawn = (F.floor((at + 1) * F.col("part") + F.col("start")) > F.floor(at * F.col("part") + F.col("start"))).cast("long")
    return (joined.withColumn("rate", rate).withColumn("part", part).withColumn("start", start)
            .withColumn("copies", F.floor("rate") + drawn)
            .select(F.col("i").alias(id_col), "size", "source", "h", F.col("words").alias("source_size"), "target",
                    "copies", (F.col("size") * F.col("copies")).alias("taken")))


def emit(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: every document as often as its copies say, columns unchanged."""
    mixed = mix(docs, text, source, id_col, **options)
    keys = [fresh(docs, f"_key{k}") for k in range(5)]
    rows = plain_keys(docs, [id_col, source], keys[:4]).withColumn(keys[4], F.xxhash64(text))
    # Rows alike in id, source and text share the copies drawn for them.
    alike = (plain_keys(mixed, [id_col, "source"], keys[:4]).withColumnRenamed("h", keys[4])
             .groupBy(*keys).agg(F.sum("copies").alias("_sum"), F.count("*").alias("_n")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    times = (F.floor(F.col("_sum") / F.col("_n")) + (F.col("_at") <= F.col("_sum") % F.col("_n")).cast("long")).cast("int")
    return (rows.join(alike, keys).withColumn("_at", place).withColumn("_times", times)
            .withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).select(*docs.columns))
