"""How far the sources of a language differ in their terms, from sorted word-start pointers.

A term is a run of ASCII letters and non-ASCII characters, A-Z lower-cased.  In each
task the Arrow text buffer of a slice of documents is taken as it is: one pointer per term start,
grouped by source, sorted by a multikey quicksort whose characters are eight bytes wide (a run of pointers
equal so far is sorted by its next eight bytes, and only runs whose terms go on are cut again).  Equal runs then
give, per source, the occurrences of a term and the documents that hold it; only these sums are
shuffled.  A slice holds whole documents and about ``SLICE`` bytes.

Each language keeps the terms found in at least ``least`` of its documents.  With N the
occurrences of kept terms in a group (a source of a language, or the language) and V their number, a term counted ``count`` times
there has p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)); two such numbers differ by floor((p - q)**2 / (p + q)).
``pairs`` adds this up over all kept terms for each two sources of a language, in blocks of
terms whose size keeps a block's table at ``CELLS`` numbers; ``tops`` lists the terms a source uses most above its language.

Defined cases: null text, lang or source is ''; documents without terms still make their group occur; repeated rows
are documents of their own; a language of one source has no pairs; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .buffers import LOWER, SLICE, runs, slices, text_buffer
from .common import arrow_map, ship, stage, text_or_empty

CELLS = 1 << 16  # numbers in a block's table of sources and terms, more where there are so many sources that sums would outnumber them
UNIT = 1_000_000_000

#: Bytes of terms: ASCII letters and all that encode other characters.
_IN_TERM = np.zeros(256, bool)
_IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True


def _wide(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int) -> np.ndarray:
    """The eight bytes of each term from its byte ``at`` on as one number; zeros follow a term's end (no term holds a zero)."""
    left = np.clip(ends - starts - at, 0, 8)
    got = np.lib.stride_tricks.sliding_window_view(low, 8)[np.minimum(starts + at, len(low) - 8)]
    got = np.ascontiguousarray(got).view(">u8").ravel().astype(np.uint64)
    return np.where(left > 0, got & (np.uint64(0xFFFFFFFFFFFFFFFF) << ((8 - np.maximum(left, 1)) * 8).astype(np.uint64)), np.uint64(0))


def sort_pointers(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): pointers in term order, equal terms in the order given; ``first`` marks the first of each equal run.

    ``low`` is padded by eight zeros.
    """
    key = _wide(low, starts, ends, 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.ones(len(order), bool)
    first[1:] = key[1:] != key[:-1]
    lengths = ends - starts
    at = 8
    longer = lengths[order] > at
    while longer.any():
        run = np.cumsum(first) - 1
        open_runs = np.zeros(run[-1] + 1, bool)
        open_runs[run[longer]] = True
        open_runs &= np.bincount(run) > 1
        places = np.flatnonzero(open_runs[run])
        if not len(places):
            break
        part = order[places]
        key = _wide(low, starts[part], ends[part], at)
        sub = np.lexsort((key, run[places]))  # places of a run stay the run's
        order[places] = part[sub]
        key, run = key[sub], run[places]
        first[places[1:]] |= (run[1:] == run[:-1]) & (key[1:] != key[:-1])
        at += 8
        longer = np.zeros(len(order), bool)
        longer[places] = lengths[order[places]] > at
    return order, first


def slice_counts(texts: pa.Array, group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, occurrences, documents) of one slice of documents, whose groups are numbers."""
    buf, offsets = text_buffer(texts)
    starts, ends, doc = runs(buf, offsets, _IN_TERM)
    if not len(starts):
        return [], *(np.zeros(0, np.int64) for _ in range(3))
    by_group = np.argsort(group[doc], kind="stable")  # inside a run: by group, then by document
    starts, ends, doc = starts[by_group], ends[by_group], doc[by_group]
    low = np.concatenate((LOWER[buf], np.zeros(8, np.uint8)))
    order, first = sort_pointers(low, starts, ends)
    g, d = group[doc[order]], doc[order]
    new = first.copy()
    new[1:] |= g[1:] != g[:-1]
    at = np.flatnonzero(new)
    fresh_doc = new.copy()
    fresh_doc[1:] |= d[1:] != d[:-1]
    raw = low.tobytes()
    heads = order[at]
    terms = [raw[a:b] for a, b in zip(starts[heads].tolist(), ends[heads].tolist())]
    return terms, g[at], np.diff(np.append(at, len(order))), np.add.reduceat(fresh_doc.astype(np.int64), at)


COUNTS = StructType([StructField("lang", StringType()), StructField("source", StringType()), StructField("term", StringType()),
                     StructField("n", LongType()), StructField("docs", LongType())])


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", size: int = SLICE) -> DataFrame:
    """(lang, source, term, n, docs), added up; a row of the empty term tells that the group occurs."""
    def apply(batches):
        for batch in batches:
            for b in slices(batch, "text", size):
                names = pa.StructArray.from_arrays([b.column(c).cast(pa.string()) for c in ("lang", "source")], ["l", "s"])
                code, groups = {}, []
                for g in names.to_pylist():
                    groups.append(code.setdefault((g["l"], g["s"]), len(code)))
                keys = list(code)
                terms, g, n, k = slice_counts(b.column("text"), np.array(groups, np.int64))
                g = np.concatenate((g, np.arange(len(keys))))  # and a row per group
                nothing = np.zeros(len(keys), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([x[p] for x in keys], pa.string()).take(pa.array(g)) for p in (0, 1)),
                     pa.array([*terms, *[b""] * len(keys)], pa.binary()).cast(pa.string()),
                     pa.array(np.concatenate((n, nothing))), pa.array(np.concatenate((k, nothing)))], names=COUNTS.names)
    rows = docs.select(*(text_or_empty(F.col(c).cast("string")).alias(a) for c, a in ((text, "text"), (lang, "lang"), (source, "source"))))
    return arrow_map(rows, apply, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(count: str, total: str, terms: str) -> Column:
    """p of a term counted ``count`` times; decimals, as counts times the unit may pass a long."""
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(10,0)) * CAST({count} + 2 AS DECIMAL(20,0))) "
                  f"div CAST({total} + 2 * {terms} AS DECIMAL(20,0))")


def kept_counts(counts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """From staged term counts: (lang, source, term, n, p, q) of each kept term that a group holds, and the groups as
    (lang, source, sources, v, zero): their language's numbers of sources and kept terms, and p at count 0 (null if v is 0)."""
    whole = (counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
             .filter(F.col("docs") >= least).drop("docs"))
    whole = stage(whole, "whole")
    rows = stage(counts.filter("term <> ''").join(whole, ["lang", "term"]), "kept")
    langs = (counts.filter("term = ''").groupBy("lang").agg(F.count("*").alias("sources"))
             .join(whole.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count("*").alias("v")), "lang", "left")
             .fillna(0, ["lang_n", "v"]))
    held = rows.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = (counts.filter("term = ''").select("lang", "source").join(held, ["lang", "source"], "left").fillna(0, ["group_n"])
              .join(langs, "lang").withColumn("zero", F.when(F.col("v") > 0, _p("0", "group_n", "greatest(v, 1)"))))
    groups = stage(groups, "groups")
    rows = rows.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", _p("n", "group_n", "v").alias("p"), _p("total", "lang_n", "v").alias("q"))
    return stage(rows, "weights"), groups


PAIRS = "lang string, source string, item string, value long"


def _block_pairs(held: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums over one block's terms for all ordered pairs of a language's sources."""
    sources = groups["source"].to_pylist()
    place = {x: k for k, x in enumerate(sources)}
    terms, column = np.unique(np.array(held["term"].to_pylist(), object), return_inverse=True) if len(held) else ([], [])
    p = np.zeros((len(sources), len(terms)), np.int64)
    if len(held):
        p[:] = np.array(groups["zero"].to_pylist(), np.int64)[:, None]
        p[[place[x] for x in held["source"].to_pylist()], column] = held["p"].to_numpy()
    one, other, value = [], [], []
    for a in range(len(sources) - 1):
        d = p[a] - p[a + 1:]
        one.append(np.full(len(d), a))
        other.append(np.arange(a + 1, len(sources)))
        value.append((d * d // np.maximum(p[a] + p[a + 1:], 1)).sum(1))
    one, other, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, other, value))
    names = pa.array(sources, pa.string())
    lang = groups["lang"].to_pylist()[:1] * (2 * len(one))
    return pa.table({"lang": pa.array(lang, pa.string()), "source": names.take(pa.array(np.concatenate((one, other)))),
                     "item": names.take(pa.array(np.concatenate((other, one)))), "value": np.concatenate((value, value))})


def pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language."""
    blocks = F.expr(f"greatest(1, ceil(v / greatest(1, least(greatest({CELLS}, sources * sources), {CELLS * 256}) div sources)))").cast("int")
    sized = groups.withColumn("blocks", blocks)
    per_lang = sized.groupBy("lang").agg(F.max("blocks").alias("blocks"))
    left = rows.join(per_lang, "lang").select(
        "lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"))
    right = sized.select("lang", "source", "zero", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    ship(rows.sparkSession)
    got = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(_block_pairs, PAIRS)
    return got.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def tops(rows: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each term a source uses more than its language does."""
    f = F.expr("((p - q) * (p - q)) div (p + q)")
    return rows.filter("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), f.alias("value"))


def ranked(values: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = values.withColumn("rank", F.row_number().over(order))
    out = out.filter(F.col("rank") <= most) if most is not None else out
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, least: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: of part 'pair' every other source of the language, of part 'term' the ``top`` terms."""
    counts = stage(term_counts(docs, text, lang, source), "terms")
    rows, groups = kept_counts(counts, least)
    return ranked(pairs(rows, groups), "pair").unionByName(ranked(tops(rows), "term", top))
