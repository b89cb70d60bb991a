"""Document fingerprints: weighted SimHash, searched through permuted block tables.

Terms are adjacent word pairs (and the last word alone); each votes with its
letters as weight on all 64 bits of its hash, for a set bit or against it. A fingerprint
has the bits that more than half of the weight votes for, so the share of
equal bits of two fingerprints follows the angle between their weighted terms.

Search: the 64 bits fall into ``blocks`` blocks; two fingerprints within
``radius`` bits agree in at least ``blocks - radius`` whole blocks.  One table per
choice of that many blocks holds all fingerprints with those blocks in front;
fingerprints that agree in a table's front are compared in full.  Searches take a
stated set of queries, and copies fold to one fingerprint first.

Everything here is DataFrame work.  Votes are sums, two bits packed into each
64-bit sum (32 bits apart: a text may weigh up to 2**32 letters).

Defined cases: a null text is the empty text, with fingerprint 0; documents
ascend by id, nulls first, then text hash; repeated rows (same id and text) are
one document of that order and get the same result each; the one after
the last is the first; a single document follows itself.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, global_rank, plain_keys, stage, text_or_empty

LANES = (1 << 32) + 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(rows: DataFrame, keys: list[str], text: str, out: str = "fingerprint") -> DataFrame:
    """(keys..., out) per distinct key of ``rows``; a text without words has fingerprint 0."""
    w = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    words = rows.select(*keys, w.alias("_w"))
    pairs = words.select(*keys, F.inline_outer(F.arrays_zip(F.col("_w").alias("a"), F.expr("slice(_w, 2, size(_w))").alias("b"))))
    votes = pairs.select(*keys, F.xxhash64("a", "b").alias("_h"),
                         sum(F.coalesce(F.length(c), F.lit(0)) for c in ("a", "b")).cast("long").alias("_n"))
    packed = [F.sum(F.shiftrightunsigned("_h", b).bitwiseAND(F.lit(LANES)) * F.col("_n")).alias(f"_s{b}") for b in range(32)]
    sums = votes.groupBy(*keys).agg(F.sum("_n").alias("_all"), *packed)
    bits = []
    for b in range(32):
        low, high = F.col(f"_s{b}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"_s{b}", 32)
        for bit, lane in ((b, low), (b + 32, high)):
            bits.append(F.when(2 * lane > F.col("_all"), F.lit(_signed(1 << bit)).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, reduce(lambda x, y: x.bitwiseOR(y), bits).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits of two fingerprints."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def block_tables(radius: int, blocks: int) -> list[int]:
    """Masks (signed) of the blocks in front, one per table."""
    if not 0 < radius < blocks <= 64:
        raise ValueError("needs 0 < radius < blocks <= 64")
    edge = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1) for k in range(blocks)]
    return [_signed(sum(block[k] for k in front)) for front in combinations(range(blocks), blocks - radius)]


def within(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(q, f, bits): for every fingerprint of ``queries`` (column q) all of ``index`` (column f) within ``radius`` bits."""
    masks = F.array(*[F.lit(m).cast("long") for m in block_tables(radius, blocks)])

    def tables(df, c):
        return (df.select(c).distinct().select(c, F.posexplode(masks).alias("table", "mask"))
                .select(c, "table", F.col(c).bitwiseAND(F.col("mask")).alias("front")))
    a, b = tables(queries, "q").alias("a"), tables(index, "f").alias("b")
    bits = F.bit_count(F.col("q").bitwiseXOR(F.col("f")))
    met = a.join(b, (F.col("a.table") == F.col("b.table")) & (F.col("a.front") == F.col("b.front")) & (bits <= radius))
    return met.select("q", "f", bits.alias("bits")).distinct()


def edited(docs: DataFrame, text: str = "text", id_col: str = "doc_id"):
    """The order of the documents, and their edited texts.

    Returns (rows, texts): ``rows`` (i, h, n_chars, rank, next) for every row of ``docs``,
    ``texts`` (_none, _id, h, text, edited) per row.  Only ids and lengths are ranked; the
    texts are dealt once by document, and what moves besides is the part of each text that its predecessor
    takes over.
    """
    names, on = ["_none", "_id"], ["_none", "_id", "h"]
    t = text_or_empty(text)
    rows = plain_keys(stage(docs.select(F.col(id_col).alias("i"), F.xxhash64(t).alias("h"),
                                        F.length(t).cast("long").alias("n_chars")), "lengths"), ["i"], names)
    ranked = stage(global_rank(rows.distinct(), [F.col("i").asc_nulls_first(), F.col("h")]), "order")
    total = ranked.count()
    after = F.pmod(F.col("rank") + 1, F.lit(max(total, 1)))
    takes = (ranked.select(after.alias("rank"), F.floor(F.col("n_chars") / 4).alias("_take"),
                           *[F.col(c).alias(f"{c}_to") for c in on])
             .join(ranked.select("rank", *on), "rank").drop("rank"))
    whole = plain_keys(docs.select(F.col(id_col).alias("i"), t.alias("text")), ["i"], names).drop("i")
    whole = whole.withColumn("h", F.xxhash64("text"))
    heads = (whole.join(takes, on).select(*[F.col(f"{c}_to").alias(c) for c in on],
                                          F.expr("substring(text, 1, cast(_take AS int))").alias("_head"))
             .groupBy(*on).agg(F.first("_head").alias("_head")))
    n = F.length("text")
    texts = whole.join(heads, on).select(*on, "text", F.concat(
        F.substring("text", F.lit(1), (n - F.floor(n / 4)).cast("int")), "_head").alias("edited"))
    return rows, ranked.withColumn("next", after), texts


def compare(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint (longs), near_edited, near_next."""
    on = ["_none", "_id", "h"]
    rows, order, texts = edited(docs, text, id_col)
    both = texts.select(*on, F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(
        F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t")))).alias("_x"))
    both = both.select(*on, "edited_sha256", "_x.v", "_x.t")
    prints = stage(fingerprints(both, [*on, "edited_sha256", "v"], "t"), "prints")
    own = prints.filter("v = 0").drop("v")
    other = prints.filter("v = 1").select(*on, F.col("fingerprint").alias("edited_fingerprint"))
    known = order.select(*on, "rank", "next").join(own, on)
    following = known.select(F.col("rank").alias("next"), F.col("fingerprint").alias("_following"))
    result = known.join(other, on).join(following, "next").select(
        *on, "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_following")).alias("near_next"))
    return rows.join(result, on).drop(*on).withColumnRenamed("i", id_col)


def search(prints: DataFrame, id_col: str = "doc_id", every: int = 100, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Add ``n_near`` to rows that hold a fingerprint: for every ``every``-th id, which make up the
    query set, the number of distinct fingerprints of all rows within ``radius`` bits
    (its own included); null for other rows."""
    asked = prints.filter(F.col(id_col) % every == 0).select(F.col("fingerprint").alias("q"))
    found = within(asked, prints.select(F.col("fingerprint").alias("f")), radius, blocks)
    n = found.groupBy(F.col("q").alias("fingerprint")).agg(F.count("*").alias("n_near"))
    return prints.join(n, "fingerprint", "left").withColumn(
        "n_near", F.when(F.col(id_col) % every == 0, F.col("n_near")))
