"""Jaccard join of word-shingle sets by set relations: blocks of index lists are skipped by position, and
a set's answers are derived from those of a highly similar set.

A document's set holds the hashes of its distinct shingles.  Equal sets are folded first, so copies
cost nothing.  All sets follow one order of shingles, the frequent ones last (a sketch of fixed size tells them;
it decides cost, never results).  Two sets that link share a shingle in their first
``n - ceil(percent * n / 100) + 1``, the prefixes, which alone are indexed.

1. *Index.*  An index list has the sets whose prefix holds a shingle, with size and position.  Each
   set takes the list head it shares most with; where they link, the set becomes a member of that head's
   cluster and is kept as its difference from the head (heads of heads are followed by composing differences).
2. *Skipping.*  Lists then hold clusters, once each, cut into blocks by size band and position, at most about ``BLOCK``
   entries each.  Two blocks meet only if their size ranges and first positions leave room for a link: all shingles
   before a first common one are lost to the overlap.
3. *Answers.*  For two clusters that meet, the overlap of their heads is computed once.  Distances obey the triangle inequality, so heads too far apart
   for their radii end it; otherwise every member's overlap follows from the heads' and from the small differences, without its set.

Links between sets of one cluster or of joined clusters need no row of their own: the answer is the class of each
document.  Whole sets are formed again, from the texts, for those sets that stand in a candidate pair, so no
table of all sets is ever written.

Shingles are compared as 64-bit hashes, sets of one content as 128-bit digests.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with
nothing, copies included; fewer words than a shingle make one shingle; repeated rows are rows of one class; a class's id is its smallest document
id, null ids counting last.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .buffers import shingle_hashes, slices
from .common import arrow_map, stage, text_or_empty
from .components import components

BUCKETS = 1 << 20  # counters of the frequency sketch
SEGMENTS = 64
BLOCK = 256
FILTER_BITS = 1 << 26  # of the filter for sets in candidate pairs


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    h = np.sort(hashes)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([p.view(np.int64) for p in parts] or [np.zeros(0, np.int64)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(flat))


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def parities(h: np.ndarray) -> np.ndarray:
    """A bit per place, of about as many places as there are hashes: whether an odd number of hashes falls there.

    Each hash that only one of two sets holds changes one bit, so the bits that differ are at most such hashes.
    """
    power = max(6, len(h).bit_length() - 1)
    odd = np.bincount((h >> np.uint64(64 - power)).astype(np.int64), minlength=1 << power) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _name(text: str) -> int:
    """Place of a text in the filter of wanted texts."""
    return xxhash.xxh3_64_intdigest(text.encode()) % FILTER_BITS


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.tobytes(), 1)


def _unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(counts), np.int64)


def frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles of all texts per bucket of their hashes; ``BUCKETS`` numbers reach the driver."""
    kinds = "segment int, slice int, counts binary"

    def apply(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for part in slices(b, "t"):
                of = np.concatenate(shingle_hashes(part.column("t"), size))
                counts += np.bincount((of >> np.uint64(44)).astype(np.int64), minlength=BUCKETS)
        if counts.any():
            at = int(counts[::997].sum()) % 64
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SEGMENTS), pa.int32()), pa.array([at] * SEGMENTS, pa.int32()),
                 pa.array([_packed(c) for c in np.split(counts, SEGMENTS)])], names=["segment", "slice", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(_unpacked(c.as_py()) for c in t["counts"])
        return pa.table({"segment": t["segment"].slice(0, 1), "slice": pa.array([0], pa.int32()), "counts": [_packed(total)]})
    part = arrow_map(docs.select("t"), apply, kinds)
    for keys in (("segment", "slice"), ("segment",)):
        part = part.groupBy(*keys).applyInArrow(add, kinds)
    out = np.zeros((SEGMENTS, BUCKETS // SEGMENTS), np.int64)
    for r in part.collect():
        out[r.segment] = _unpacked(r.counts)
    return out.ravel()


def classes(counts: np.ndarray) -> np.ndarray:
    """0 for a bucket of usual height, else how many times it doubles that."""
    usual = 4 * counts.mean() + 64
    return np.where(counts > usual, np.minimum(np.log2(np.maximum(counts, 1) / usual) + 1, 40), 0).astype(np.uint8)


def prefix_length(n: int, percent: int) -> int:
    return n + percent * n // -100 + 1


def _sets(docs: DataFrame, size: int, percent: int, height: np.ndarray) -> DataFrame:
    """(i, n, key, name, prefix in order, bits) of every row."""
    def apply(batches):
        for b in (part for batch in batches for part in slices(batch, "t")):
            sets = [distinct(h) for h in shingle_hashes(b.column("t"), size)]
            first = []
            for h in sets:
                most = height[(h >> np.uint64(44)).astype(np.int64)]
                h = h[np.argsort(most, kind="stable")] if most.any() else h
                first.append(h[:prefix_length(len(h), percent)] if len(h) else h)
            yield pa.RecordBatch.from_arrays(
                [b.column("i"), pa.array([len(h) for h in sets], pa.int64()), pa.array([digest(h) for h in sets], pa.binary()),
                 pa.array([_name(t) for t in b.column("t").to_pylist()], pa.int64()), _lists(first),
                 _lists([parities(h) for h in sets])], names=["i", "n", "key", "name", "prefix", "bits"])
    return arrow_map(docs, apply, StructType([docs.schema["i"], StructField("n", LongType()), StructField("key", BinaryType()),
                                              StructField("name", LongType()), StructField("prefix", ArrayType(LongType())),
                                              StructField("bits", ArrayType(LongType()))]))


def _with_sets(pairs: DataFrame, named: DataFrame, docs: DataFrame, size: int, a: str, b: str) -> DataFrame:
    """Pairs of sets (columns ``a``, ``b``) with their sizes n and m and whole sets x and y, formed from their texts again.

    The sets are dealt by key once; both joins read that one shuffle.
    """
    pairs = stage(pairs.join(named.toDF(a, "key_a", "name_a"), a).join(named.toDF(b, "key_b", "name_b"), b), "named_pairs")
    wanted = pairs.select(F.explode(F.array("name_a", "name_b")).alias("name"))
    segments = (wanted.select((F.col("name") / 32768).cast("int").alias("segment"), (F.col("name") % 32768).alias("b"))
                .groupBy("segment").agg(F.bitmap_construct_agg("b").alias("bits")).collect())  # FILTER_BITS in all
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in segments:
        bits[r.segment * 4096:(r.segment + 1) * 4096] = np.frombuffer(r.bits, np.uint8)

    def apply(batches):
        for b in batches:
            at = np.array([_name(t) for t in b.column("t").to_pylist()], np.int64)
            b = b.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 > 0))
            for part in slices(b, "t"):
                found = {}  # a copy in the same slice is not sent again
                for h in shingle_hashes(part.column("t"), size):
                    h = distinct(h)
                    found[digest(h)] = h
                yield pa.RecordBatch.from_arrays([pa.array([*found], pa.binary()), _lists([*found.values()])], names=["key", "set"])
    made = arrow_map(docs.select("t"), apply, StructType([StructField("key", BinaryType()), StructField("set", ArrayType(LongType()))]))
    made = made.dropDuplicates(["key"])
    return (pairs.join(made.select(F.col("key").alias("key_a"), F.col("set").alias("x")), "key_a")
            .join(made.select(F.col("key").alias("key_b"), F.col("set").alias("y")), "key_b")
            .drop("key_a", "key_b", "name_a", "name_b")
            .withColumns({"n": F.size("x").cast("long"), "m": F.size("y").cast("long")}))


def _linked(inter: str, n: str, m: str, percent: int):
    return F.expr(f"{100 + percent} * {inter} >= {percent} * ({n} + {m})")


def _room(a: str, b: str, percent: int, first: str = "at"):
    """Sizes and first positions of two entries leave room for a link."""
    return F.expr(f"100 * {a}.hi >= {percent} * {b}.lo AND 100 * {b}.hi >= {percent} * {a}.lo "
                  f"AND {100 + percent} * ({a}.{first} + {b}.{first}) <= {100 - percent} * ({a}.hi + {b}.hi)")


def _index(rows: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """(s, n, pos, token, df, head) of prefix shingles that stand in more than one set's prefix; ``head`` is the list's smallest set."""
    sets = rows.filter("n > 0").join(heads.select(F.col("s").alias("r")), "r", "left_semi")
    entries = sets.select(F.col("r").alias("s"), "n", F.posexplode("prefix").alias("pos", "token")).repartition("token")
    # Lists are counted from the entries as dealt: both read one shuffle, as both ask for every column of it.
    lists = entries.groupBy("token").agg(F.count("*").alias("df"), F.min("s").alias("head"), F.min("n").alias("least"),
                                         F.min("pos").alias("first")).filter("df > 1 AND least > 0 AND first >= 0")
    return stage(entries.join(lists.drop("least", "first"), "token"), "index")


def _prefixes(index: DataFrame, rows: DataFrame) -> DataFrame:
    """(s, n, prefix, bits), the prefix with only those shingles that other prefixes have too, as 32 bits of each: a part
    of one set in a row."""
    short = F.shiftright(F.shiftleft("token", 32), 32).cast("int")
    shared = index.groupBy("s", "n").agg(F.collect_list(short).alias("prefix"))
    return stage(shared.join(rows.select(F.col("r").alias("s"), "bits"), "s"), "prefixes")


def common_at_most(a: str, b: str):
    """At least the number of shingles that two lists have in common, given with 32 bits of each."""
    alike = F.size(a) - F.size(F.array_distinct(a))  # different shingles of one list whose 32 bits are the same
    return F.size(F.array_intersect(a, b)) + alike


def _with_near_prefixes(pairs: DataFrame, prefixes: DataFrame, percent: int, a: str, b: str, spread: DataFrame | None = None) -> DataFrame:
    """Pairs (columns ``a``, ``b``) whose prefixes have enough in common.

    Of the two prefixes one ends first in the order; what it does not share with the other stands nowhere
    in the other set.  If that is more than a link allows (for heads of clusters: with the edits of their members,
    ``spread``, on top), or if more of their parities differ, the pair goes.  Prefixes hold 32 bits of a shingle: what
    falls together only makes the count of common ones larger, so no link is lost.
    """
    def beside(columns: dict) -> DataFrame:
        sides = [prefixes.select(F.col("s").alias(at), *[F.col(c).alias(f"{name}{k}") for c, name in columns.items()])
                 for k, at in ((1, a), (2, b))]
        return met.join(sides[0], a).join(sides[1], b)
    met = pairs
    odd = F.aggregate(F.zip_with("b1", "b2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    met = beside({"n": "n", "bits": "b"}).withColumn("odd", F.when(F.size("b1") == F.size("b2"), odd).otherwise(0)).drop("b1", "b2")
    if spread is None:
        met = met.withColumns({"d1": F.lit(0), "d2": F.lit(0)})
    else:
        met = (met.join(spread.toDF(a, "d1"), a, "left").join(spread.toDF(b, "d2"), b, "left").fillna(0, ["d1", "d2"]))
    # Twice what either set may lack: |difference| is at most apart, of which one side has its share by size.
    apart = f"(floor({100 - percent} * (n1 + d1 + n2 + d2) / {100 + percent}D) + d1 + d2)"
    length = "({n} - ceil({p} * {n} / 100D) + 1)"
    # Most pairs end here, by sizes and parities, before the longer prefixes are dealt.
    met = met.filter(f"100 * (n1 + d1) >= {percent} * (n2 - d2) AND 100 * (n2 + d2) >= {percent} * (n1 - d1)").filter(f"odd <= {apart}")
    met = beside({"prefix": "p"}).withColumn("c", common_at_most("p1", "p2")).drop("p1", "p2")
    return met.filter(f"2 * ({length.format(n='n1', p=percent)} - c) <= {apart} + n1 - n2 OR "
                      f"2 * ({length.format(n='n2', p=percent)} - c) <= {apart} + n2 - n1").select(*pairs.columns)


def _picks(index: DataFrame) -> DataFrame:
    """(s, h): the list head that a set shares most prefix shingles with."""
    met = index.filter("s > head").groupBy("s", F.col("head").alias("h")).agg(F.count("*").alias("c"))
    return met.groupBy("s").agg(F.max(F.struct("c", (-F.col("h")).alias("h"))).alias("x")).select("s", (-F.col("x.h")).alias("h"))


def _clusters(picks: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(s, h, n, gone, more), and the links (s, h) that were checked: sets that link with their pick, given with whole sets,
    then re-based on the head of that, by composing differences."""
    now = (picks.select("s", "h", "n", "m", F.array_except("y", "x").alias("gone"), F.array_except("x", "y").alias("more"))
           .withColumn("inter", F.col("n") - F.size("more")).filter(_linked("inter", "n", "m", percent)))
    now = stage(now.select("s", "h", "n", "gone", "more"), "clusters")
    links = now.select("s", "h")
    while True:
        up = now.select(F.col("s").alias("h"), F.col("h").alias("g"), F.col("gone").alias("g2"), F.col("more").alias("m2"))
        if not now.join(up, "h", "left_semi").limit(1).count():
            return now, links
        gone = F.concat(F.array_except("gone", "m2"), F.array_except("g2", "more"))
        more = F.concat(F.array_except("m2", "gone"), F.array_except("more", "g2"))
        far = F.col("g").isNotNull()
        now = stage(now.join(up, "h", "left").select(
            "s", F.coalesce("g", "h").alias("h"), "n", F.when(far, gone).otherwise(F.col("gone")).alias("gone"),
            F.when(far, more).otherwise(F.col("more")).alias("more")), "clusters")


def _cluster_pairs(index: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(h, k, alone) with h < k: clusters whose blocks leave room for a link; ``alone``: both are single sets."""
    marks = members.select("s", "h").unionByName(members.select(F.col("h").alias("s"), "h").distinct())
    entries = index.filter("s IS NOT NULL").join(marks, "s", "left")  # both uses below read one shuffle
    alone = entries.filter("h IS NULL").select("token", F.col("s").alias("h"), F.col("n").alias("lo"), F.col("n").alias("hi"),
                                               F.col("pos").alias("at"), "df", F.lit(True).alias("alone"))
    entries = alone.unionByName(
        entries.filter("h IS NOT NULL").groupBy("token", "h").agg(
            F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("pos").alias("at"), F.max("df").alias("df"))
        .withColumn("alone", F.lit(False)))
    band = F.floor(F.log("hi") / F.lit(-math.log(percent / 100)))
    late = F.expr(f"{100 + percent} * at > {100 - percent} * hi").cast("long")
    chunk = F.pmod(F.xxhash64("h"), F.ceil(F.col("df") / BLOCK))
    blocks = (entries.groupBy("token", (band * 2 + late).alias("kind"), chunk.alias("chunk"))
              .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("at").alias("at"),
                   F.collect_list(F.struct("h", "lo", "hi", "at", "alone")).alias("items")))
    a, b = blocks.alias("a"), blocks.alias("b")
    before = F.expr("a.kind < b.kind OR (a.kind = b.kind AND a.chunk <= b.chunk)")
    met = a.join(b, F.expr("a.token = b.token") & before & _room("a", "b", percent))
    same = F.expr("a.kind = b.kind AND a.chunk = b.chunk").alias("same")
    met = met.select(same, F.explode("a.items").alias("x"), F.col("b.items").alias("items")).select("same", "x", F.explode("items").alias("y"))
    met = met.filter((F.expr("x.h < y.h") | (~F.col("same") & F.expr("x.h <> y.h"))) & _room("x", "y", percent))
    # The common shingles counted are the first ones, so what follows the last of them bounds the overlap.
    swap = F.expr("x.h < y.h")
    p, q = F.when(swap, F.col("x")).otherwise(F.col("y")), F.when(swap, F.col("y")).otherwise(F.col("x"))
    met = met.select(p.alias("p"), q.alias("q")).select(
        F.col("p.h").alias("h"), F.col("q.h").alias("k"), F.expr("p.alone AND q.alone").alias("alone"), F.col("p.hi").alias("n"),
        F.col("q.hi").alias("m"), F.col("p.at").alias("i"), F.col("q.at").alias("j"))
    met = met.groupBy("h", "k").agg(F.count("*").alias("c"), F.min("alone").alias("alone"), F.max("n").alias("n"), F.max("m").alias("m"),
                                    F.max("i").alias("i"), F.max("j").alias("j"))
    return met.filter(f"NOT alone OR {100 + percent} * (c + least(n - i, m - j) - 1) >= {percent} * (n + m)").select("h", "k", "alone")


def _overlap(a: str, b: str):
    return F.size(F.array_intersect(a, b))


def _answers(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(h, k) of clusters, given with whole sets, with a link between them."""
    t = percent / 100 - 1e-9
    apart = members.groupBy("h").agg(F.max(F.expr("1 - (n - size(more)) / double(n + size(gone))")).alias("r"))
    near = (pairs.withColumnsRenamed({"n": "nh", "m": "nk"}).withColumn("o", F.col("nh") - F.size(F.array_except("x", "y")))
            .join(apart.withColumnRenamed("r", "rh"), "h", "left")
            .join(apart.select(F.col("h").alias("k"), F.col("r").alias("rk")), "k", "left").fillna(0.0, ["rh", "rk"]))
    # Far heads have no linked members: distance is at least that of the heads less both radii.
    linked = _linked("o", "nh", "nk", percent)
    near = near.filter(linked | (~F.col("alone") & F.expr(f"1 - o / double(nh + nk - o) <= 1 - {t} + rh + rk")))
    near = stage(near.withColumns({c: F.when(~linked, F.col(c)) for c in "xy"}), "near_heads")
    done = near.filter(linked).select("h", "k")
    near = near.filter(~linked & ~F.col("alone"))
    none = F.array().cast("array<long>")
    of = members.select("h", F.col("s").alias("m"), "n", "gone", "more")
    left = near.join(of, "h").unionByName(near.withColumns({"m": F.col("h"), "n": F.col("nh"), "gone": none, "more": none}))
    left = left.select("h", "k", "n", "gone", "more", "nk", "rk",
                       (F.col("o") - _overlap("gone", "y") + _overlap("more", "y")).alias("o"))
    left = stage(left.filter(f"1 - o / double(n + nk - o) <= 1 - {t} + rk"), "left")
    other = near.join(of.withColumnRenamed("h", "k"), "k").unionByName(
        near.withColumns({"m": F.col("k"), "n": F.col("nk"), "gone": none, "more": none}))
    other = other.select("h", "k", "n", "gone", "more", "nh", "rh", "o", (_overlap("more", "x") - _overlap("gone", "x")).alias("u"))
    other = stage(other.filter(f"1 - (o + u) / double(n + nh - o - u) <= 1 - {t} + rh").drop("o"), "other")
    # A member that links with the other head joins the clusters; only what is open then is compared member by member.
    one = left.filter(_linked("o", "n", "nk", percent)).select("h", "k").unionByName(
        other.join(near.select("h", "k", "o"), ["h", "k"]).filter(_linked("(o + u)", "n", "nh", percent)).select("h", "k")).distinct()
    one = stage(one, "one")
    x, z = left.join(one, ["h", "k"], "left_anti").alias("x"), other.alias("z")
    inter = (F.col("x.o") + F.col("z.u") + _overlap("x.gone", "z.gone") - _overlap("x.more", "z.gone")
             - _overlap("x.gone", "z.more") + _overlap("x.more", "z.more"))
    two = (x.join(z, ["h", "k"]).filter(f"100 * x.n >= {percent} * z.n AND 100 * z.n >= {percent} * x.n")
           .select("h", "k", F.col("x.n").alias("n"), F.col("z.n").alias("m"), inter.alias("o"))
           .filter(_linked("o", "n", "m", percent)).select("h", "k").distinct())
    return done.unionByName(one).unionByName(two)


def classes_of(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id_col, ``n_shingles``, ``component_id`` (smallest id reachable by links of ``percent`` or more)."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be 1 to 100")
    docs = docs.select(F.col(id_col).alias("i"), text_or_empty(text).alias("t"))
    height = classes(frequencies(docs, size))
    rows = stage(_sets(docs, size, percent, height).withColumn("r", F.monotonically_increasing_id()), "sets")
    heads = stage(rows.filter("n > 0").groupBy("key").agg(
        F.min("r").alias("s"), F.min_by("name", "r").alias("name"), F.min("i").alias("low")), "heads")
    named = heads.select("s", "key", "name")
    links = None
    if percent < 100:  # else equal sets alone link
        index = _index(rows, heads, percent)
        prefixes = _prefixes(index, rows)
        picks = stage(_with_near_prefixes(_picks(index), prefixes, percent, "s", "h"), "picks")
        members, links = _clusters(_with_sets(picks, named, docs, size, "s", "h"), percent)
        pairs = stage(_cluster_pairs(index, members, percent), "cluster_pairs")
        spread = members.groupBy("h").agg(F.max(F.size("gone") + F.size("more")).alias("d"))
        pairs = stage(_with_near_prefixes(pairs, prefixes, percent, "h", "k", spread), "pairs")
        found = _answers(_with_sets(pairs, named, docs, size, "h", "k"), members, percent)
        links = links.toDF("u", "v").unionByName(found.toDF("u", "v"))
    if links is None:
        labels = heads.select("key", F.col("low").alias("component_id"))
    else:
        roots = components(links)
        rooted = heads.join(roots, heads["s"] == roots["node"], "left").withColumn("root", F.coalesce("root", "s"))
        labels = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("key", "component_id")
    full = rows.filter("n > 0").join(labels, "key").select("i", "n", "component_id")
    return (full.unionByName(rows.filter("n = 0").select("i", "n", F.col("i").alias("component_id")))
            .select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), "component_id"))
