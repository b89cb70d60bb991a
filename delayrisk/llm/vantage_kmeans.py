"""Centroid clustering on integer vectors, the nearest centroid found in a vantage-point tree.

Each round the driver builds a vantage-point tree over the ``k`` centroids (a table
bounded by ``k``) and ships it to the tasks.  Each vector searches it best-first: of
the nodes it has not opened, the one whose lower bound is smallest is next, and the search
ends when that bound exceeds the best distance.  The pruning radius is inclusive:
a node that may hold an equal distance is opened, since ties go to the smaller number.
The vectors of a batch take their steps together, each on its own path, so that a step is one matrix product
per node.  Bounds are floating point with a margin; distances at vantage points and in leaves are
exact integers, and they alone decide.

Sums are added up inside a task, one row per cluster leaves it; so a cluster with a third of all
vectors costs no more than another.

Defined cases: a vector that is null, has another length or holds a null or non-finite component is left
out; repeated ids are vectors of their own, and a null id is one; fewer vectors than ``k`` give fewer centroids;
an empty table gives no rows.  Components of any finite size are computed
exactly (with Python integers where doubles cannot); a distance or sum too large for a long is null.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import arrow_map, stage

MARGIN = 1e-9  # of a bound, for its rounding
PLAIN = 1 << 53  # doubles are exact integers below
SLICES = 64


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) exactly: doubles while squared distances stay exact, else Python integers; ``scale`` is a power of two."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    if not y.size or x.shape[1] * (2 * np.abs(y).max()) ** 2 < PLAIN:
        return y
    return np.array([[int(v) * scale if abs(v) >= PLAIN else int(np.floor(v * scale)) for v in r] for r in x.tolist()], object)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``x`` to each row of ``c``."""
    if x.dtype == object or c.dtype == object:
        x, c = x.astype(object), c.astype(object)
        if x.size:
            x, c = np.vectorize(int, otypes=[object])(x), np.vectorize(int, otypes=[object])(c)
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)


def _root(d: np.ndarray) -> np.ndarray:
    """Roots in units of 2**64, so that those of the largest doubles can be told."""
    if d.dtype == object:
        return np.array([isqrt(v << 128) / (1 << 128) for v in d.ravel().tolist()], np.float64).reshape(d.shape)
    return np.sqrt(d) / 2.0 ** 64


@dataclass
class Node:
    """``points``: the vantage point, or a leaf's centroids; ``children``: (number of node, least, greatest distance to the vantage point)."""
    points: list[int]
    children: list[tuple[int, float, float]]


def build(centroids: np.ndarray, leaf: int = 4) -> list[Node]:
    """Vantage-point tree, root first: the points of a node are cut at the median distance to its first point."""
    nodes: list[Node] = []

    def grow(points: list[int]) -> int:
        at = len(nodes)
        nodes.append(Node(points, []))
        if len(points) <= leaf:
            return at
        vantage, rest = points[0], points[1:]
        nodes[at].points = [vantage]
        d = _root(squared(centroids[[vantage]], centroids[rest]))[0]
        order = np.argsort(d, kind="stable")
        for half in np.array_split(order, 2):
            nodes[at].children.append((grow([rest[k] for k in half]), float(d[half].min()), float(d[half].max())))
        return at
    grow(list(range(len(centroids))))
    return nodes


def search(tree: list[Node], centroids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance) per row of ``x``, ties to the smaller number, and how many distances were computed."""
    n = len(x)
    wide = x.dtype == object or centroids.dtype == object
    best, who = np.full(n, -1, object if wide else np.float64), np.full(n, len(centroids), np.int32)
    reach = np.full(n, np.inf)  # root of best
    bound = np.full((n, len(tree)), np.inf)  # of nodes known and not opened
    bound[:, 0] = 0
    computed = 0
    while True:
        turn = bound.argmin(1)
        least = bound[np.arange(n), turn]
        going = np.flatnonzero((least <= reach * (1 + MARGIN)) & np.isfinite(least))
        if not len(going):
            return who, best, computed
        for at in np.unique(turn[going]):
            rows = going[turn[going] == at]
            node, low = tree[at], bound[rows, at]
            d = squared(x[rows], centroids[node.points])
            computed += d.size
            for k, c in enumerate(node.points):
                better = (who[rows] == len(centroids)) | (d[:, k] < best[rows]) | ((d[:, k] == best[rows]) & (c < who[rows]))
                best[rows[better]], who[rows[better]] = d[better, k], c
            reach[rows] = _root(best[rows])
            bound[rows, at] = np.inf
            if node.children:
                near = _root(d[:, 0])
                for child, inner, outer in node.children:
                    gap = np.maximum(inner - near, near - outer)
                    # Roots of large distances are rounded, so a bound is taken lower by as much.
                    bound[rows, child] = np.maximum(np.maximum(gap - MARGIN * (near + outer), low), 0)


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def kept(vectors: DataFrame, id_col: str, vector: str, dims: int) -> DataFrame:
    """(i, v) of the vectors that take part, v as doubles."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).alias("i"), v.alias("v")).filter((F.size("v") == dims) & sound)


def first_centroids(rows: DataFrame, k: int, salt: str, scale: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of salt and id; a null id comes last, equal ids go by their components."""
    h = F.sha2(F.concat(F.lit(salt), F.col("i").cast("string")).cast("binary"), 256)
    low = rows.select("v", h.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return scaled(np.array([r.v for r in low], np.float64).reshape(len(low), len(low[0].v) if low else 0), scale)


def _adder(dims: int):
    def add(t: pa.Table) -> pa.Table:
        """Totals of one cluster's rows; a row per task at most."""
        n, sums = sum(t["n"].to_pylist()), [0] * dims
        for row in t["sums"].to_pylist():
            sums = [a + int(b) for a, b in zip(sums, row)]
        return pa.table({"cluster": t["cluster"].slice(0, 1).cast(pa.int32()), "slice": pa.array([0], pa.int32()),
                         "n": pa.array([n], pa.int64()), "sums": pa.array([[str(s) for s in sums]], pa.list_(pa.string()))})
    return add


SUMS = StructType([StructField("cluster", IntegerType()), StructField("slice", IntegerType()),
                   StructField("n", LongType()), StructField("sums", ArrayType(StringType()))])


def totals(rows: DataFrame, centroids: np.ndarray, scale: int, dims: int) -> DataFrame:
    """(cluster, slice, n, sums as integer texts) of each cluster that has vectors."""
    tree = build(centroids)

    def apply(batches):
        counts, sums = np.zeros(len(centroids), np.int64), [[0] * dims for _ in centroids]
        for b in batches:
            x = scaled(_matrix(b.column(0), dims), scale)
            who, _, _ = search(tree, centroids, x)
            for c in np.unique(who):
                mine = x[who == c]
                counts[c] += len(mine)
                sums[c] = [a + int(s) for a, s in zip(sums[c], mine.sum(0))]
        full = np.flatnonzero(counts)
        at = int(hashlib.md5(counts.tobytes()).hexdigest()[:4], 16) % SLICES
        yield pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array([at] * len(full), pa.int32()), pa.array(counts[full]),
             pa.array([[str(s) for s in sums[c]] for c in full], pa.list_(pa.string()))], names=SUMS.names)
    part = arrow_map(rows.select("v"), apply, SUMS)
    for keys in (("cluster", "slice"), ("cluster",)):
        part = part.groupBy(*keys).applyInArrow(_adder(dims), SUMS)
    return part


def moved(rows: DataFrame, centroids: np.ndarray, scale: int, dims: int) -> np.ndarray:
    """Centroids after one round; the driver gets a row per cluster."""
    new = [[int(v) for v in c] for c in centroids]
    for r in totals(rows, centroids, scale, dims).collect():
        new[r.cluster] = [int(s) // r.n for s in r.sums]
    large = max((abs(v) for c in new for v in c), default=0)
    return np.array(new, np.float64 if dims * (2 * large) ** 2 < PLAIN else object).reshape(len(new), dims)


def assign(rows: DataFrame, centroids: np.ndarray, scale: int, dims: int) -> DataFrame:
    """(i, cluster, distance) per vector."""
    tree = build(centroids)
    top = (1 << 63) - 1

    def apply(batches):
        for b in batches:
            who, d, _ = search(tree, centroids, scaled(_matrix(b.column(1), dims), scale))
            d = [int(v) if v <= top else None for v in d]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(who, pa.int32()), pa.array(d, pa.int64())],
                                             names=["i", "cluster", "distance"])
    return arrow_map(rows, apply, StructType([rows.schema["i"], StructField("cluster", IntegerType()),
                                              StructField("distance", LongType())]))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5,
            dims: int = 64, scale: int = 256, salt: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """((i, cluster, distance) per vector, the final centroids as integers)."""
    rows = stage(kept(vectors, id_col, vector, dims), "vectors")
    centroids = first_centroids(rows, k, salt, scale)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(rows, centroids, scale, dims)
    if not len(centroids):
        return rows.select("i", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).filter(F.lit(False)), centroids
    return assign(rows, centroids, scale, dims), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add ``cluster_inertia``, ``inertia`` (sums of distance) and ``centroid_sha256`` to staged assignments."""
    names = [(c, hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest()) for c, row in enumerate(centroids)]
    spark = assigned.sparkSession
    name = spark.createDataFrame(names, "cluster int, centroid_sha256 string")  # k rows
    # A distance too large for a long makes the sums unknown as well.
    whole = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    per = assigned.groupBy("cluster").agg(whole.alias("s"))
    every = assigned.agg(whole.alias("t"))
    per = per.crossJoin(every).select("cluster", F.expr("try_cast(s AS bigint)").alias("cluster_inertia"),  # one row each: k rows
                                      F.expr("try_cast(t AS bigint)").alias("inertia"))
    return assigned.join(F.broadcast(per), "cluster").join(F.broadcast(name), "cluster")
