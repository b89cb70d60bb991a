"""Repeated passages by a sparse suffix array over minimiser positions.

Every passage of ``LENGTH`` words has one content-selected position: the
smallest hash of ``GRAM`` words that begins among its first ``SPREAD`` words.
Only suffixes that begin at such positions are kept, as the hashes of their first
``RIGHT`` and ``LENGTH`` words, and sorted; neighbours with the same
first ``RIGHT`` words are candidates, and neighbours with the same first
``LENGTH`` words prove a repeat to the right.  Candidates are then extended: the
passages of ``LENGTH`` words around them (up to ``SPREAD - 1`` words to the left) are
sorted and compared in the same way.
A repeated passage holds its selected position in each of its documents, so none is missed;
what comes out are the maximal stretches of each document in which every
``LENGTH`` words also stand in another document.

Sorting deals rows by range of (hash, document), so a passage that a third of
all documents share spreads over many tasks, and neighbours, not pairs, are
compared; where two ranges meet, only their two outermost rows reach the driver.

Defined cases: null, empty and short texts have no repeats; repetition
inside one document only does not count; repeated rows (same id and text) repeat
each other, their spans are listed once; a null id is an id; words are taken as they are (case and
punctuation count), white space does not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from .common import arrow_map, stage, text_or_empty, width

LENGTH, GRAM, SPREAD = 50, 8, 30
RIGHT = LENGTH - SPREAD + 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.cumprod(np.full(n - 1, base, np.uint64))
    return out


class Hashes:
    """Hashes of all runs of a text's words, from one sum over the text."""

    def __init__(self, words: list[bytes]):
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(w) for w in words], np.uint64)
        self.n = len(words)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, self.n), dtype=np.uint64)))
        self.back = _powers(_INVERSE, self.n)

    def runs(self, starts: np.ndarray, size: int) -> np.ndarray:
        x = (self.sums[starts + size] - self.sums[starts]) * self.back[starts]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def selected(h: Hashes) -> np.ndarray:
    """For every passage start, its selected position."""
    n = h.n - LENGTH + 1
    if n < 1:
        return np.zeros(0, np.int64)
    grams = h.runs(np.arange(n + SPREAD - 1), GRAM)
    out = np.empty(n, np.int64)
    for at in range(0, n, 1 << 16):
        end = min(at + (1 << 16), n)
        out[at:end] = np.lib.stride_tricks.sliding_window_view(grams[at:end + SPREAD - 1], SPREAD).argmin(1) + np.arange(at, end)
    return out


def suffixes(words: list[bytes]):
    """(passage starts' selected positions, distinct positions, hash of RIGHT words, of LENGTH words or 0)."""
    h = Hashes(words)
    of = selected(h)
    at = np.unique(of)
    right = h.runs(at, RIGHT)
    whole = np.zeros(len(at), np.uint64)
    fits = at + LENGTH <= h.n
    whole[fits] = h.runs(at[fits], LENGTH) | np.uint64(1)      # 0: the text ends before
    return h, of, at, right, whole


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))


def _suffix_rows(batches):
    """One row per document and distinct suffix (by its two hashes): a, b, d, at."""
    for batch in batches:
        parts = []
        for k, t in enumerate(batch.column("t").to_pylist()):
            _, _, at, right, whole = suffixes(_words(t))
            if len(at):
                # Inside a document, a suffix seen before adds nothing.
                _, first = np.unique(np.stack((right, whole)), axis=1, return_index=True)
                first.sort()
                parts.append((np.full(len(first), k), at[first], right[first], whole[first]))
        if parts:
            k, at, right, whole = (np.concatenate(x) for x in zip(*parts))
            who = pa.array(k)
            yield pa.RecordBatch.from_arrays(
                [_long(right), _long(whole), batch.column("d").take(who), pa.array(at.astype(np.int32))],
                names=["a", "b", "d", "at"])


def _compare(batches):
    """Keep sorted rows whose neighbour has the same ``a`` (alike: and the same ``b``, if not 0),
    and each part's first and last row (edge 1, 2, or 3 for both)."""
    held, begun = None, False

    def out(batch, n, same_a, same_b, first, last):
        edge = np.zeros(n, np.int32)
        if first:
            edge[0] += 1
        if last:
            edge[-1] += 2
        keep = same_a | (edge > 0)
        # Hashes are asked for again only where parts meet.
        inside = pa.array(edge == 0)
        cols = [pc.if_else(inside, None, c) if name in "ab" else c for name, c in zip(batch.schema.names, batch.columns)]
        cols += [pa.array(same_a), pa.array(same_b), pa.array(edge)]
        return pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "candidate", "alike", "edge"]).filter(pa.array(keep))

    def flags(batch, before, after):
        a = batch.column("a").to_numpy()
        b = batch.column("b").to_numpy()
        a = np.concatenate(([before[0]] if before else [~a[0]], a, [after[0]] if after else [~a[-1]]))
        b = np.concatenate(([before[1]] if before else [0], b, [after[1]] if after else [0]))
        step_a = a[1:] == a[:-1]
        step_b = step_a & (b[1:] == b[:-1]) & (b[1:] != 0)
        return step_a[:-1] | step_a[1:], step_b[:-1] | step_b[1:]

    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            after = (batch.column("a")[0].as_py(), batch.column("b")[0].as_py())
            yield out(held, held.num_rows, *flags(held, before, after), not begun, False)
            begun = True
            before = (held.column("a")[-1].as_py(), held.column("b")[-1].as_py())
        held = batch
    if held is not None:
        yield out(held, held.num_rows, *flags(held, before, None), not begun, True)


def neighbours(rows: DataFrame) -> DataFrame:
    """Sort ``rows`` by (a, b, d) and give (d, at) of those whose neighbour shares ``a``; ``alike``: and ``b``.

    ``rows`` should be a stored table: dealing by range samples it first.
    """
    order = [F.col(c) for c in ("a", "b", "d")]
    sorted_ = rows.repartitionByRange(width(rows), *order).sortWithinPartitions(*order)
    flag = [StructField("candidate", BooleanType()), StructField("alike", BooleanType()), StructField("edge", IntegerType())]
    tagged = sorted_.withColumn("part", F.spark_partition_id())
    kept = stage(arrow_map(tagged, _compare, StructType([*tagged.schema.fields, *flag])), "neighbours")
    # Two rows per part at most: what the parts' ends say about each other.
    ends = {(r["part"], e): (r["a"], r["b"]) for r in kept.filter("edge > 0").select("part", "edge", "a", "b").collect()
            for e in (1, 2) if r["edge"] & e}
    parts = sorted({p for p, _ in ends})
    met = [(p, q) for p, q in zip(parts, parts[1:]) if ends[p, 2][0] == ends[q, 1][0]]
    same = [(p, q) for p, q in met if ends[p, 2][1] == ends[q, 1][1] != 0]

    def at_end(pairs):
        last, first = [p for p, _ in pairs], [q for _, q in pairs]
        is_last = F.col("edge").bitwiseAND(2) > 0
        is_first = F.col("edge").bitwiseAND(1) > 0
        return (is_last & F.col("part").isin(last)) | (is_first & F.col("part").isin(first))
    if met:
        kept = kept.withColumn("candidate", F.col("candidate") | at_end(met))
    if same:
        kept = kept.withColumn("alike", F.col("alike") | at_end(same))
    return kept.filter("candidate").select("d", "at", "alike")


def _around(text: str, at: list[int], proved: list[bool]):
    """One document's proved stretches (first, end), and the passages around its candidates:
    their two hashes, first words, and where the same passage first stands in the document."""
    h, of, where, right, whole = suffixes(_words(text))
    index = np.searchsorted(where, at)
    # A candidate stands for all suffixes of its document with its hashes.
    likely = np.isin(right, right[index])
    begin = where[np.isin(whole, whole[index[np.array(proved, bool)]]) & (whole != 0)]
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > begin[:-1] + LENGTH
    first, last = begin[new], begin[np.append(new[1:], True)] if len(begin) else begin
    # All documents of a passage must offer it, also those that have proved it by other neighbours.
    start = np.flatnonzero(likely[np.searchsorted(where, of)])
    key, key2 = h.runs(start, LENGTH), h.runs(start, LENGTH - 1) >> np.uint64(33) | np.uint64(1)
    if len(start):
        _, at_first, which = np.unique(key, return_index=True, return_inverse=True)
        origin = start[at_first][which]
    else:
        origin = start
    return first, last + LENGTH, key, key2, start, origin


def _extend(batches):
    """``_around`` for documents with candidates; proved stretches come with b = 0 and their end."""
    for batch in batches:
        parts, size = [], 0

        def flush():
            k, a, b, at, end, origin = (np.concatenate(x) for x in zip(*parts))
            ints = lambda x: pa.array(x.astype(np.int32))
            return pa.RecordBatch.from_arrays([_long(a), ints(b), batch.column("d").take(pa.array(k)), ints(at), ints(end), ints(origin)],
                                              names=["a", "b", "d", "at", "end", "origin"])
        for k, (t, at, proved) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("t", "at", "proved")))):
            first, end, key, key2, start, origin = _around(t, at, proved)
            none = np.zeros(len(first), np.uint64)
            parts.append((np.full(len(first) + len(start), k), np.concatenate((none, key)), np.concatenate((none, key2)),
                          np.concatenate((first, start)), np.concatenate((end, start + LENGTH)), np.concatenate((first, origin))))
            size += len(first) + len(start)
            if size > 100_000:
                yield flush()
                parts, size = [], 0
        if size:
            yield flush()


def repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, start_word, end_word): maximal repeated stretches of each document, one row each."""
    base = docs.select(F.col(id_col).alias("i"), text_or_empty(text).alias("t"))
    # Rows are named by a hash of id and text; ids come back by the table of these names.
    base = base.withColumn("d", F.xxhash64("i", "t"))
    long, ints = lambda n: StructField(n, LongType()), lambda n: StructField(n, IntegerType())
    array = stage(arrow_map(base.select("d", "t"), _suffix_rows,
                            StructType([long("a"), long("b"), long("d"), ints("at")])), "suffixes")
    near = neighbours(array).groupBy("d").agg(F.collect_list(F.struct("at", "alike")).alias("c"))
    texts = base.select("d", "t").join(near, "d").select("d", "t", F.col("c.at").alias("at"), F.col("c.alike").alias("proved"))
    around = stage(arrow_map(texts, _extend, StructType(
        [long("a"), ints("b"), long("d"), ints("at"), ints("end"), ints("origin")])), "passages")
    found = neighbours(around.filter("b <> 0 AND origin = at").select("a", "b", "d", "at")).filter("alike").select("d", "at")
    # A passage that comes again inside its document is repeated where its first one is.
    more = (around.filter("b <> 0 AND origin <> at").select("d", F.col("at").alias("later"), F.col("origin").alias("at"))
            .join(found, ["d", "at"], "left_semi").select("d", F.col("later").alias("at")))
    spans = (around.filter("b = 0").select("d", "at", "end")
             .unionByName(found.unionByName(more).select("d", "at", (F.col("at") + LENGTH).alias("end"))))
    by_doc = Window.partitionBy("d").orderBy("at", "end")
    before = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    stretch = F.sum(F.when(F.col("at") <= F.col("_before"), 0).otherwise(1)).over(by_doc.rowsBetween(Window.unboundedPreceding, 0))
    merged = (spans.withColumn("_before", before).withColumn("_stretch", stretch)
              .groupBy("d", "_stretch").agg(F.min("at").alias("start_word"), F.max("end").alias("end_word")))
    return (merged.join(base.select("d", "i").distinct(), "d")
            .select(F.col("i").alias(id_col), "start_word", "end_word"))
