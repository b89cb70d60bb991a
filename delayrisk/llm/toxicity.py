"""Toxicity: class-conditional Kneser-Ney language models.

Two interpolated Kneser-Ney bigram models, one of toxic and one of ordinary
labelled texts, differ only in their own counts: below the class's unigrams
both fall back to one shared distribution, the Kneser-Ney continuation counts
of both classes pooled.  Every level counts distinct left contexts, so copies
of a passage count once, and takes an absolute discount, so an expression that
is rare in a class says no more about it than the shared counts do.  A text's evidence is its length-normalised
log-likelihood ratio (per word, and per square root of words); a logistic
curve fitted on labelled rows that gave no counts turns it into a score.

What is bounded and what is not: every labelled row gives counts, except a
quarter of the ids that is kept for the curve, which is fitted on at most
``max_rows`` of those (smallest seeded hash of the id first).  N-grams are
counted in Spark on 64-bit hashes of the words, dealt by pair; words frequent in
the curve's texts are two bytes there (they decide size, never results).  Texts find their labels
by bitmaps of the labelled ids, of fixed size, and only those whose place
says nothing for sure are shuffled.  To the driver come only bitmaps, words and
pairs above the discount in a class: all others have the same probability in
both classes.  Every text of the input is scored whole, in one map over the
documents, without any shuffle.  The model knows words by 64-bit hashes in
sorted arrays, so a worker holds no dictionary of it.

Defined cases: a null or empty text, or one without any word, has ratio zero
and gets the curve's value there; a curve without slope gives every text the share of toxic labels; a null id is scored like any other; labels
that are null or not 0/1 are left out; without labels of both classes every
score is the share of toxic labels (0.0 without any label).  Repeated rows are
scored each.  An id labelled twice counts under its largest label.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import arrow_map, fresh, stage, width

WORDS = re.compile(r"[^\W_]+")
BLOCK = 1 << 17  # words that are scored at once
PART = 1 << 18   # words whose repeated n-grams are dropped before the shuffle
BITS = 1 << 26   # of the bitmaps of labelled ids; more ids only send more texts through the join
FREQUENT = (1 << 15) - 1  # words that are shuffled as two bytes; this number stands for any other
PARTS = 2048     # runs of pairs that are counted at once, at least


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def hashes(ws) -> np.ndarray:
    """Signed 64-bit hashes of words."""
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in ws], np.uint64).view(np.int64)


@dataclass
class Counts:
    """Per-class n-gram counts of the labelled texts."""

    vocab: np.ndarray                # sorted hashes of words above the discount in a class, or in a pair that is
    uni: np.ndarray                  # (2, V) distinct left neighbours, per class
    rest: np.ndarray                 # (2,) the same of all other words together
    hist: np.ndarray                 # (2, V) sum of the counts of pairs that begin with the word
    pair: np.ndarray                 # (P,) left * (V + 1) + right, sorted, of pairs above the discount in a class
    pair_n: np.ndarray               # (2, P) their counts: distinct words before the pair


@dataclass
class Model:
    """Log-ratio tables of words and pairs above the discounts, small enough to broadcast."""

    vocab: np.ndarray                # sorted hashes
    p: np.ndarray                    # (2, V + 1) unigram level, last: any other word
    back: np.ndarray                 # (2, V + 1) weight of the unigram level after a word
    pair: np.ndarray
    pair_p: np.ndarray               # (2, P) discounted pair probability
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)
    constant: float | None = None

    def _evidence(self, ws: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word but the first, after the one before it."""
        index: dict = {}
        at = np.array([index.setdefault(w, len(index)) for w in ws], np.int64)
        h, none = hashes(index), len(self.vocab)
        place = np.searchsorted(self.vocab, h)
        known = place < none
        known[known] = self.vocab[place[known]] == h[known]
        w = np.where(known, place, none)[at]
        left, right = w[:-1], w[1:]
        q = self.back[:, left] * self.p[:, right]
        if len(self.pair):
            key = left * (none + 1) + right
            pos = np.searchsorted(self.pair, key)
            pos[pos == len(self.pair)] = 0
            hit = self.pair[pos] == key
            q[:, hit] += self.pair_p[:, pos[hit]]
        return np.log(q[0] / q[1])

    def ratios(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: the sum of its words' evidence, and the number of words."""
        total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        block, owner = [], []

        def flush():
            # Every stretch begins with the word before it, which is evidence for no text (the last owner).
            got = np.bincount(np.repeat(*np.array(owner).T)[1:], self._evidence(block), len(texts) + 1)
            total[:] += got[:-1]
            block.clear(), owner.clear()
        for k, t in enumerate(texts):
            ws = words(t)
            n[k] = len(ws)
            for at in range(0, len(ws), BLOCK):
                part = ws[at:at + BLOCK]
                block.append(ws[at - 1] if at else "")
                block.extend(part)
                owner.extend(((len(texts), 1), (k, len(part))))
                if len(block) >= BLOCK:
                    flush()
        if block:
            flush()
        return total, n

    def ratio(self, text: str | None) -> tuple[float, int]:
        total, n = self.ratios([text])
        return float(total[0]), int(n[0])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        a, b, c = self.curve
        x, y = features(*self.ratios(texts))
        return 1 / (1 + np.exp(-np.clip(a + b * x + c * y, -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


#: Neutral words added to every text's length, so that one word does not decide about a short text.
NEUTRAL = 20


def features(total, n):
    """The ratio per word, and per square root of words, both within [-1, 1] after scaling."""
    return np.tanh(4 * total / (n + NEUTRAL)), np.tanh(total / np.sqrt(n + NEUTRAL) / 4)


def kneser_ney(c: Counts, discount: float, pair_discount: float, toxic_share: float) -> Model:
    """Interpolated Kneser-Ney; counts up to the discount give all their mass to the level below.

    The shared level weighs the classes by ``toxic_share``, as they occur in a
    corpus at large.  Both classes give it the same mass, so a word that
    neither knows beyond its discount has ratio 1.  The discounts are those of the
    smaller class; the larger one's grow with its counts, so that the same share of
    a class is discounted away in both, however many labels each has.
    """
    v = len(c.vocab)
    weigh = np.array([toxic_share, 1 - toxic_share])
    shared = np.append(weigh @ c.uni, weigh @ c.rest)
    shared /= shared.sum()
    size = c.uni.sum(1) + c.rest
    larger = size / size.min()
    own = np.maximum(c.uni - discount * larger[:, None], 0) / size[:, None]
    known = np.maximum(own.sum(1), 1e-12)
    freed = min(1 - known.min(), 1 - 1e-6)
    p = np.column_stack([own * ((1 - freed) / known)[:, None], np.zeros(2)]) + freed * shared
    back, pair_p, left = np.ones((2, v + 1)), np.zeros((2, len(c.pair))), c.pair // (v + 1)
    for k in (0, 1):
        total = np.append(c.hist[k], 0)
        pair_p[k] = np.maximum(c.pair_n[k] - pair_discount * larger[k], 0) / np.maximum(total[left], 1)
        back[k] -= np.bincount(left, pair_p[k], v + 1)
    return Model(c.vocab, p, np.maximum(back, 1e-6), c.pair, pair_p)


def _logistic(z: np.ndarray, y: np.ndarray, ridge: float, steps: int = 50) -> np.ndarray:
    b = np.zeros(z.shape[1])
    hold = np.append(1e-6, np.full(len(b) - 1, ridge))      # the constant is free
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = z.T @ (z * (q * (1 - q) + 1e-9)[:, None]) + np.diag(hold)
        step = np.linalg.solve(h, z.T @ (y - q) - hold * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression of y on the columns of x, with slopes of zero or more.

    A likelier toxic text never scores lower, also where few rows would say so by
    chance; without any slope left, every score is about the share of label 1.
    """
    scale = np.maximum(np.abs(x).mean(0), 1e-9)
    used = list(range(x.shape[1]))
    while True:
        b = _logistic(np.column_stack([np.ones(len(x)), (x / scale)[:, used]]), y, ridge)
        kept = [k for k, slope in zip(used, b[1:]) if slope >= 0]
        if kept == used:
            break
        used = kept
    out = np.zeros(x.shape[1] + 1)
    out[0] = b[0]
    out[[k + 1 for k in used]] = b[1:] / scale[used]
    return tuple(float(t) for t in out)


def _triples(batches):
    """Per ``PART`` words: the distinct (left, word, word before and class); '' stands before a text's first word."""
    index, rows, size = {"": 0}, [], 0

    def flush():
        n, h = len(index), hashes(index)
        u, a, b = (np.concatenate(x).astype(np.int64) for x in zip(*rows))
        # Three places below 2^18 + 3 and the class fit in 63 bits; rows with one left word come together.
        key, before = np.divmod(np.unique((a * n + b) * (2 * n) + u), 2 * n)
        index.clear(), rows.clear()
        index[""] = 0
        # 47 bits tell the words before one pair apart.
        return pa.RecordBatch.from_arrays(
            [pa.array(h[key // n]), pa.array(h[key % n]),
             pa.array(((h[before >> 1] & ((1 << 47) - 1)) << 1) | (before & 1))], names=["a", "b", "u"])
    for batch in batches:
        for label, t in zip(batch.column("y").to_pylist(), batch.column("t")):
            ws, at = ["", "", *words(t.as_py())], 0
            while at < len(ws) - 2:
                ids = np.array([index.setdefault(w, len(index)) for w in ws[at:at + 2 + PART - size]], np.int32)
                rows.append((ids[:-2] * 2 + label, ids[1:-1], ids[2:]))
                at += len(ids) - 2
                size += len(ids) - 2
                if size == PART:
                    yield flush()
                    size = 0
    if rows:
        yield flush()


def _bytes(column: pa.Array, at: int, to: int) -> np.ndarray:
    """The bytes of rows ``at`` to ``to`` of a binary column."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(data, np.uint8)[ends[at]:ends[to]] if data is not None else np.zeros(0, np.uint8)


def _coded(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places in the sorted ``table``; ``FREQUENT`` for values that are not there."""
    at = np.searchsorted(table, values)
    found = np.append(table, 0)[at] == values
    return np.where(found & (at < len(table)), at, FREQUENT).astype(np.uint16)


class Packing:
    """Triples of a part as runs of bytes, one per range of a hash of the pair: three codes of two bytes each,
    the class in the first one's high bit, and 64-bit hashes of words without a code."""

    def __init__(self, frequent: np.ndarray, parts: int):
        self.words, self.parts = np.unique(frequent)[:FREQUENT], parts
        self.lefts = np.unique(self.words & ((1 << 47) - 1))

    def pack(self, batches):
        for batch in _triples(batches):
            a, b, u = (batch.column(c).to_numpy() for c in ("a", "b", "u"))
            mixed = (a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ b.view(np.uint64)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            part = ((mixed >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            values = np.column_stack((a, b, u >> 1))[order]
            codes = np.column_stack((_coded(self.words, a), _coded(self.words, b), _coded(self.lefts, u >> 1)))[order]
            other = codes == FREQUENT
            codes[:, 0] |= (u[order] & 1).astype(np.uint16) << 15
            parts, first = np.unique(part[order], return_index=True)
            ends = np.append(first, len(order))
            hashed = np.append(0, np.cumsum(other.sum(1)))[ends]
            blobs = [pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
                     for to, x in ((6 * ends, codes), (8 * hashed, values[other]))]
            yield pa.RecordBatch.from_arrays([pa.array(parts), *blobs], names=["part", "codes", "hashes"])

    def tally(self, batches):
        """(a, b, t, o) of sorted runs: per pair the distinct words before it, in each class."""
        words, lefts = (np.append(x, np.zeros(FREQUENT + 1 - len(x), np.int64)) for x in (self.words, self.lefts))
        codes, hashed, size, now = [], [], 0, None

        def flush():
            c = np.concatenate(codes).view(np.uint16).reshape(-1, 3)
            y = (c[:, 0] >> 15).astype(np.int64)
            c[:, 0] &= FREQUENT
            v = np.column_stack((words[c[:, 0]], words[c[:, 1]], lefts[c[:, 2]]))
            v[c == FREQUENT] = np.concatenate(hashed).view(np.int64)
            a, b, u = v[:, 0], v[:, 1], (v[:, 2] << 1) | y
            order = np.lexsort((u, b, a))
            a, b, u = a[order], b[order], u[order]
            pair = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            once = pair | np.append(True, u[1:] != u[:-1])
            at = np.flatnonzero(pair)
            t, n = (np.add.reduceat(x.astype(np.int64), at) for x in (once & (u & 1 == 1), once))
            codes.clear(), hashed.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[at], b[at], t, n - t)], names=["a", "b", "t", "o"])
        for batch in batches:
            part = batch.column("part").to_numpy()
            first = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist()] if len(part) else []
            for at, to in zip(first, [*first[1:], len(part)]):
                # A pair's triples are all of one part.
                if part[at] != now and size >= PART:
                    yield flush()
                    size = 0
                now = part[at]
                codes.append(_bytes(batch.column("codes"), at, to))
                hashed.append(_bytes(batch.column("hashes"), at, to))
                size += len(codes[-1]) // 6
        if codes:
            yield flush()


def frequent_words(texts: DataFrame) -> np.ndarray:
    """Hashes of at most ``FREQUENT`` words that the texts (column t) have most often, and more than once."""
    def apply(batches):
        for b in batches:
            found = Counter(w for t in b.column("t") for w in words(t.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(hashes(found)), pa.array(list(found.values()), pa.int64())], names=["w", "n"])
    most = arrow_map(texts.select("t"), apply, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1")
    return most.orderBy(F.desc("n"), "w").limit(FREQUENT).toPandas()["w"].to_numpy(np.int64)


def count(sample: DataFrame, discount: float, pair_discount: float, frequent: np.ndarray | None = None,
          labels: DataFrame | None = None) -> Counts:
    """Count n-grams of the whole ``sample`` (columns y, t; with ``labels``, i and y, those of its rows i, t that have
    one) in Spark; what comes back are counts of words and pairs above the discounts.  ``frequent``: hashes of words to be
    shuffled as two bytes."""
    mapped = partial(arrow_map, sample.select("y", "t")) if labels is None else partial(_labelled, sample, labels)

    has = lambda c: F.sum(c.cast("long"))
    # One exchange: what is dealt by a hash of the pair needs no other to drop repeats and to count by pair.
    packing = sample.sparkSession.sparkContext.broadcast(
        Packing(np.zeros(0, np.int64) if frequent is None else frequent, max(PARTS, width(sample))))
    packed = mapped(lambda batches: packing.value.pack(batches), "part int, codes binary, hashes binary")
    pairs = arrow_map(packed.repartition("part").sortWithinPartitions("part"), lambda batches: packing.value.tally(batches),
                      "a long, b long, t long, o long").cache()
    total = np.array(pairs.agg(*[F.coalesce(has(F.col(c) > 0), F.lit(0)) for c in ("t", "o")]).first(), np.float64)
    kept = pairs.filter((F.col("t") > pair_discount) | (F.col("o") > pair_discount)).toPandas()
    # From Arrow: other local rows would pass through Python workers of their own, which stay.
    listed = lambda h: F.broadcast(pairs.sparkSession.createDataFrame(pa.table({"k": np.unique(h)})))
    uni = (pairs.groupBy("b").agg(has(F.col("t") > 0).alias("t"), has(F.col("o") > 0).alias("o"))
           .join(listed(kept[["a", "b"]].to_numpy(np.int64)).withColumn("paired", F.lit(True)), F.col("b") == F.col("k"), "left")
           .filter((F.col("t") > discount) | (F.col("o") > discount) | F.col("paired")).select("b", "t", "o")
           .toPandas().sort_values("b"))
    sums = (pairs.join(listed(kept["a"].to_numpy(np.int64)), F.col("a") == F.col("k"), "left_semi")
            .groupBy("a").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).toPandas())
    pairs.unpersist()
    vocab = uni["b"].to_numpy(np.int64)
    v = len(vocab)
    hist = np.zeros((2, v), np.int64)
    kept, sums = kept[kept["a"].isin(vocab)], sums[sums["a"].isin(vocab)]       # '' is no word
    at = lambda h: np.searchsorted(vocab, h.to_numpy(np.int64))
    hist[:, at(sums["a"])] = sums[["t", "o"]].to_numpy(np.int64).T
    key = at(kept["a"]) * (v + 1) + at(kept["b"])
    order = np.argsort(key)
    own = uni[["t", "o"]].to_numpy(np.float64).T.reshape(2, v)
    return Counts(vocab, own, np.maximum(total - own.sum(1), 1.0), hist,
                  key[order], kept[["t", "o"]].to_numpy(np.int64)[order].T.reshape(2, len(key)))


def _bitmap(found) -> np.ndarray:
    """A bitmap of ``BITS`` from its occurring words (at, bits)."""
    table = np.zeros(BITS // 64, np.int64)
    table[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return table


def _labelled(docs: DataFrame, rows: DataFrame, then: Callable | None = None, schema: str | None = None) -> DataFrame:
    """Rows (y, t) of ``docs`` (i, t) joined with ``rows`` (i, y; y is 0 or 1, no id twice), or what ``then`` makes of
    their batches, by ``schema``, in the worker that found them: two maps in a row would hold two workers a task, and
    executors keep them for later stages.

    Bitmaps tell the labels: a place of hashed ids is sure if no other label and no other id of ``docs`` falls there.
    Texts at sure places have their label without a shuffle, only those at doubtful ones are joined.
    """
    spark = docs.sparkSession
    docs = docs.filter(F.col("i").isNotNull())
    place = F.pmod(F.xxhash64("i"), F.lit(BITS)).alias("place")
    at, bit = F.shiftright("place", 6).alias("at"), F.expr("shiftleft(1L, cast(place % 64 as int))")
    placed = rows.select("i", "y", place)
    found = placed.groupBy(at).agg(F.bit_or(F.when(F.col("y") == 1, bit).otherwise(F.lit(0).cast("long"))).alias("t"),
                                   F.bit_or(F.when(F.col("y") == 0, bit).otherwise(F.lit(0).cast("long"))).alias("o")).toPandas()
    ones, zeros = (_bitmap(found[["at", k]].rename(columns={k: "bits"})) for k in "to")
    seen = spark.sparkContext.broadcast(ones | zeros)

    def hits(table: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        p = b.column("place").to_numpy()
        return (table[p >> 6] >> (p & 63)) & 1 == 1

    def known(batches):
        for b in batches:
            yield b.filter(pa.array(hits(seen.value, b)))
    ids = docs.select("i", place)
    strange = arrow_map(ids, known, ids.schema).join(rows.select("i"), "i", "left_anti")
    doubt = (ones & zeros) | _bitmap(strange.groupBy(at).agg(F.bit_or(bit).alias("bits")).toPandas())
    tables = spark.sparkContext.broadcast((ones & ~doubt, zeros & ~doubt, doubt))

    def sure(batches):
        for b in batches:
            one, zero, _ = tables.value
            y = hits(one, b)
            kept = pa.array(y | hits(zero, b))
            yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)).filter(kept), b.column("t").filter(kept)], names=["y", "t"])

    def doubtful(batches):
        for b in batches:
            yield b.filter(pa.array(hits(tables.value[2], b))).select(["i", "t"])
    asked = docs.select("i", "t", place)
    plain = StructType([StructField("y", IntegerType()), docs.schema["t"]])
    out = arrow_map(asked, sure, plain) if then is None else arrow_map(asked, lambda batches: then(sure(batches)), schema)
    if doubt.any():
        # Staged, or a broadcast join would leave this map and the next in one stage.
        joined = (stage(arrow_map(asked, doubtful, StructType([docs.schema["i"], docs.schema["t"]])), "doubtful")
                  .join(rows, "i").select("y", "t"))
        out = out.unionByName(joined if then is None else arrow_map(joined, then, schema))
    return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic",
        train: Column | None = None, max_rows: int = 3000, seed: int = 11,
        discount: float = 4.0, pair_discount: float = 8.0, toxic_share: float = 0.02) -> Model:
    """Fit on labelled rows for which ``train`` (a condition on ``labels``) holds.

    Three quarters of the ids give counts, all of them; at most ``max_rows``
    others fit the curve.  Ids are drawn by a seeded hash, so reruns agree.
    """
    rows = labels.filter(train) if train is not None else labels
    rows = (rows.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
            .groupBy(F.col(id_col).alias("i")).agg(F.max(label).cast("int").alias("y"))
            .withColumn("h", F.xxhash64("i", F.lit(seed))))
    shares = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    if len(shares) < 2:
        return Model(np.zeros(0, np.int64), np.ones((2, 1)), np.ones((2, 1)), np.zeros(0, np.int64), np.zeros((2, 0)),
                     constant=float(next(iter(shares), 0)))
    # A quarter of the ids, by hash, is for the curve and gives no counts.
    curve = F.pmod("h", F.lit(4)) == 0
    texts = docs.select(F.col(id_col).cast(rows.schema["i"].dataType).alias("i"), F.col(text).alias("t"))
    # At most max_rows ids: bounded, so every executor can hold them.
    picked = F.broadcast(rows.filter(curve).orderBy("h", "i").limit(max_rows).select("i", "y"))
    held = stage(texts.join(picked, "i").select("y", "t"), "curve")
    model = kneser_ney(count(texts, discount, pair_discount, frequent_words(held), rows.filter(~curve).select("i", "y")),
                       discount, pair_discount, toxic_share)
    weights = docs.sparkSession.sparkContext.broadcast(model)

    def ratios(batches):
        for b in batches:
            x = features(*weights.value.ratios(b.column("t").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("y"), *map(pa.array, x)], names=["y", "a", "b"])
    seen = arrow_map(held, ratios, "y int, a double, b double").toPandas()
    seen = seen.sort_values(["y", "a", "b"])
    if seen["y"].nunique() < 2:
        model.constant = shares[1] / (shares[0] + shares[1])
    else:
        model.curve = fit_curve(seen[["a", "b"]].to_numpy(), seen["y"].to_numpy(np.float64))
        if not any(model.curve[1:]):
            model.constant = shares[1] / (shares[0] + shares[1])
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, the probability of label 1, to every row."""
    weights = docs.sparkSession.sparkContext.broadcast(model)
    name = fresh(docs, out)

    def apply(batches):
        m = weights.value
        for b in batches:
            # 256 texts at a time, so that few are held as Python's.
            s = [m.scores(b.column(text).slice(at, 256).to_pylist()) for at in range(0, b.num_rows, 256)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([np.zeros(0), *s]))], names=[*b.schema.names, name])
    return arrow_map(docs, apply, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
