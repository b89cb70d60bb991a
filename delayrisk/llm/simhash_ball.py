"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint is the bitwise majority of the hashes of its word
shingles.  Two fingerprints within ``radius`` bits have a value within half
the radius of both: every distinct fingerprint emits all its variants in that
half ball, equal variants meet in one shuffle, and since everything that meets
is within twice half the radius of each other, linking each to the smallest of
its variant keeps every component whole without forming pairs.  A variant
is shared by at most as many fingerprints as the half ball holds (65 at radius
2), so no bucket can grow with the data: copies were folded before.

Defined cases: a null or empty text, or one without words, has fingerprint
zero and links like any other; fewer words than a shingle make one
shingle; repeated shingles vote each time; a component's id is its smallest
document id, null ids counting last (null if it has no other); repeated rows
are rows of one component.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .buffers import slices
from .common import arrow_map, fresh, stage
from .components import components, few_parts

BLOCK = 1 << 15  # shingles whose bits are counted at once
SLICE = 1 << 20  # bytes of texts that are held as Python's at once, if no text is longer


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Majority of the XXH64 hashes of the text's word shingles, unsigned."""
    # bytes.lower and bytes.split know A-Z and ASCII white space only.
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(len(words) - size + 1, 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at:at + BLOCK + size - 1] if n > 1 else words
        runs = zip(*(part[k:] for k in range(size))) if n > 1 else (words,)
        h = np.array([digest(b" ".join(r), seed) for r in runs], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, seed: int = 42,
                 out: str = "fingerprint") -> DataFrame:
    """Replace the text column by ``out``, the fingerprint as a (signed) long; other columns stay."""
    kept = [c for c in docs.columns if c != text]
    name = fresh(docs, out)

    def apply(batches):
        for b in (part for batch in batches for part in slices(batch, text, SLICE)):
            f = np.array([fingerprint(t, size, seed) for t in b.column(text).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(f.view(np.int64))],
                                             names=[*kept, name])
    fields = [docs.schema[c] for c in kept] + [StructField(name, LongType())]
    return arrow_map(docs, apply, StructType(fields))


def half_ball(radius: int) -> list[int]:
    """Masks (signed 64-bit) of all changes of at most half of ``radius`` bits."""
    if radius < 0 or radius % 2 or radius > 6:
        raise ValueError("radius must be 0, 2, 4 or 6: variants meet half-way")
    masks = [sum(1 << b for b in bits) for k in range(radius // 2 + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Star links (u, v) between distinct fingerprints (column f) that join all within ``radius``."""
    masks = F.array(*[F.lit(m).cast("long") for m in half_ball(radius)])
    variants = distinct.select("f", F.explode(masks).alias("mask")).select(
        "f", F.col("f").bitwiseXOR(F.col("mask")).alias("variant"))
    # Buckets hold at most len(masks) fingerprints, whatever the data.
    met = variants.selectExpr("f AS u", "min(f) OVER (PARTITION BY variant) AS v")
    return met.filter((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius))


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = 3,
                    seed: int = 42, radius: int = 2) -> DataFrame:
    """One row per document: id_col, ``fingerprint`` (long), ``component_id``."""
    rows, named = _groups(docs, text, id_col, size, seed, radius)
    # One row per fingerprint on the right: a hot fingerprint's rows can be split.
    return rows.join(named, "f").select(F.col("i").alias(id_col), F.col("f").alias("fingerprint"), "component_id")


def _groups(docs: DataFrame, text: str, id_col: str, size: int, seed: int, radius: int):
    """(i, h, f) per row, h the text's hash, and (f, root, component_id) per distinct fingerprint."""
    t = F.col(text)
    rows = stage(fingerprints(docs.select(F.col(id_col).alias("i"), F.xxhash64(t).alias("h"), t.alias("t")),
                              "t", size, seed, "f"), "fingerprints")
    n = rows.count()
    groups = stage(few_parts(rows.groupBy("f").agg(F.min("i").alias("low")), n), "distinct")
    roots = components(links(groups.select("f"), radius))
    rooted = groups.join(roots, groups["f"] == roots["node"], "left").select(
        "f", "low", F.coalesce("root", "f").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows, stage(few_parts(rooted.join(lowest, "root"), n), "named")


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = 3,
             seed: int = 42, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` that stand for their group: the smallest id of each component.

    Should several rows hold that id, the one with the smallest text hash
    stays (one of them, if they are alike); a component without any id keeps
    one row by the same rule.
    """
    rows, named = _groups(docs, text, id_col, size, seed, radius)
    none, some = F.col("i").isNull(), F.coalesce("i", F.lit(0).cast(docs.schema[id_col].dataType))
    heads = (rows.join(named.select("f", "root"), "f")
             .groupBy("root").agg(F.min(F.struct(none.alias("n"), some.alias("i"), F.col("h"))).alias("s"))
             .select("s.*"))
    keys = [fresh(docs, k) for k in ("none", "some", "hash")]
    row = fresh(docs, "row")
    c = F.col(id_col)
    marked = docs.select(c.isNull().alias(keys[0]), F.coalesce(c, F.lit(0).cast(docs.schema[id_col].dataType)).alias(keys[1]),
                         F.xxhash64(text).alias(keys[2]), F.struct(*docs.columns).alias(row))
    # Rows alike fold to one before texts are dealt, once; what they meet is as dealt and sorted already.
    folded = marked.groupBy(*keys).agg(F.first(row).alias(row))
    return folded.join(stage(heads.toDF(*keys), "heads"), keys, "left_semi").select(f"{row}.*")
