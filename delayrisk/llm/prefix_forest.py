"""Nearest neighbours by inner product with a forest of hash prefixes.

Each tree gives every vector a string of 64 hash bits (signs on random
hyperplanes; vectors are lengthened by one coordinate to a common norm, so
that angles order inner products).  In a tree's sorted strings the vectors that share a
prefix stand together.  A query descends in all trees to its longest
matches and ascends in all of them at the same time, bit by bit, until the nodes
it has reached hold ``want`` entries in total; what is in these nodes is
scored exactly.  How far a query ascends so depends on where it falls.

``want`` is tuned: for a bounded sample of the queries (``tune`` of them, by
seeded hash) the true neighbours are found by comparing them with all rows, and the
smallest ``want`` of a grid whose recall on them reaches ``recall`` is taken.
Everything else covers all rows.  (Evenly spread vectors of many dimensions
have no near ones to find; there the tuned ``want`` is a large share of the rows.)

Equal vectors are folded to one class first, which keeps its k + 1 smallest
ids: more can never be among a query's k nearest.  Nodes are cut into groups of bounded
size on both sides, so neither a node that many vectors share nor one that many queries
fall into meets in one task.

Defined cases: rows whose vector is null, empty, zero, or holds null or
non-finite components take no part, nor do rows with a null id; vectors of
different length are never near; repeated rows count once; ties go to smaller
ids; with fewer candidates than k, all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from .common import arrow_map, stage

BITS = 64
ENTRIES, QUERIES = 4096, 1024      # rows of a group at most (on average, by hash)


def planes(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim + 1, trees * BITS))


def codes(x: np.ndarray, extra: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """(rows, trees) hash strings, as longs whose signed order is the strings' order."""
    signs = np.column_stack((x, extra)) @ planes(x.shape[1], trees, seed) > 0
    bits = np.packbits(signs.reshape(len(x), trees, BITS), axis=2)
    return (bits.view(">u8")[:, :, 0].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _valid(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def classes(rows: DataFrame, id_col: str, vector: str, keep: int, asked: Column) -> tuple[DataFrame, DataFrame]:
    """(cls, id, place, v) of each class's ``keep`` smallest ids, and (q, cls) of all queries."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    valid = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), asked.alias("asked"))
    valid = valid.filter(F.col("id").isNotNull()).filter(_valid(F.col("v"))).select("id", "v", "asked").distinct()
    by = Window.partitionBy("v").orderBy("id")
    kept = stage(valid.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= keep)
                 .withColumn("cls", F.first("id").over(by)).select("cls", "id", "place", "v"), "classes")
    heads = kept.filter("place = 1").select("cls", F.col("v").alias("_v"))
    queries = valid.filter("asked").select(F.col("id").alias("q"), "v")
    return kept, stage(queries.join(heads, F.col("v") == F.col("_v")).select("q", "cls", F.size("v").alias("dim")), "queries")


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def index(heads: DataFrame, largest: float, trees: int, seed: int) -> DataFrame:
    """(cls, asked, dim, vec, entry codes, query codes) of each class; vec: its doubles as bytes."""
    def apply(batches):
        for b in batches:
            lists = b.column("v")
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            dims = np.diff(ends)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.stack([flat[ends[k]:ends[k] + dim] for k in at])
                norm2 = (x * x).sum(1)
                entry = codes(x, np.sqrt(np.maximum(largest - norm2, 0)), trees, seed)
                query = codes(x, np.zeros(len(x)), trees, seed)
                as_list = lambda c: pa.ListArray.from_arrays(
                    pa.array(np.arange(0, c.size + 1, trees, dtype=np.int32)), pa.array(c.ravel()))
                who = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [b.column("cls").take(who), b.column("asked").take(who), pa.array(np.full(len(at), dim, np.int32)),
                     pa.array([r.tobytes() for r in x], pa.binary()), as_list(entry), as_list(query)],
                    names=["cls", "asked", "dim", "vec", "entry", "query"])
    schema = StructType([StructField("cls", LongType()), StructField("asked", BooleanType()), StructField("dim", IntegerType()),
                         StructField("vec", BinaryType()), StructField("entry", ArrayType(LongType())), StructField("query", ArrayType(LongType()))])
    return stage(arrow_map(heads, apply, schema), "forest")


def _nodes(rows: DataFrame, strings: str, depths: list[int], *kept: str) -> DataFrame:
    """One row per tree and depth: the node (dim, tree, depth, prefix) that a string lies in.

    Depth 0 is the whole of a tree, so the first tree stands for all.
    """
    levels = F.array(*[F.lit(d) for d in depths])
    out = (rows.select(*kept, "dim", F.posexplode(strings).alias("tree", "code"))
           .select(*kept, "dim", "tree", "code", F.explode(levels).alias("depth"))
           .filter("depth > 0 OR tree = 0"))
    return out.withColumn("prefix", F.when(F.col("depth") == 0, F.lit(0).cast("long"))
                          .otherwise(F.expr(f"shiftright(code, {BITS} - depth)"))).drop("code")


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, equal ones in column order."""
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def brute_force(forest: DataFrame, asked: list, k: int) -> DataFrame:
    """(q, cls, score): nearest classes of a bounded list of (cls, vec bytes) queries, comparing all rows."""
    def apply(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                qs = [(c, v) for c, v in asked if len(v) == 8 * dim]
                if not qs:
                    continue
                cls = b.column("cls").to_numpy()[at]
                s = _matrix([v for _, v in qs], dim) @ _matrix(b.column("vec").take(pa.array(at)).to_pylist(), dim).T
                best = _top(s, k)
                q = np.repeat([c for c, _ in qs], best.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(cls[best.ravel()]), pa.array(np.take_along_axis(s, best, 1).ravel())],
                                                 names=["q", "cls", "score"])
    found = arrow_map(forest.select("cls", "dim", "vec"), apply, "q long, cls long, score double")
    by = Window.partitionBy("q").orderBy(F.desc("score"), "cls")
    return found.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k).drop("r")


def _depths(asked: DataFrame, counts: DataFrame, depths: list[int]) -> DataFrame:
    """(cls, depth, n): entries in the nodes that a query class has reached, over all trees."""
    nodes = ["dim", "tree", "depth", "prefix"]
    return (_nodes(asked, "query", depths, "cls").join(counts, nodes)
            .groupBy("cls", "depth").agg(F.sum("n").alias("n")))


def tuned(forest: DataFrame, reached: DataFrame, most: int, k: int, recall: float, tune: int, seed: int) -> int:
    """The smallest ``want`` of a grid that finds ``recall`` of the sample's true neighbours; ``most``,
    more than all trees' entries, makes every query ascend to the root."""
    sample = forest.filter("asked").orderBy(F.xxhash64("cls", F.lit(seed)), "cls").limit(tune).select("cls", "vec", "query").collect()
    if not sample:
        return most
    truth = brute_force(forest, [(r["cls"], bytes(r["vec"])) for r in sample], k).filter("q <> cls")
    hits = truth.join(forest.select("cls", "entry"), "cls").select("q", "entry").collect()      # tune * k rows at most
    counts: dict = {}
    ids = [r["cls"] for r in sample]
    for r in reached.filter(F.col("cls").isin(ids)).collect():                                 # tune * depths rows
        counts.setdefault(r["cls"], {})[r["depth"]] = r["n"]
    strings = {r["cls"]: np.array(r["query"], np.int64) for r in sample}
    # The depth at which the ascent reaches a true neighbour: its longest common prefix in any tree.
    meets = [(r["q"], max(BITS - int(x).bit_length() for x in
                          (np.array(r["entry"], np.int64) ^ strings[r["q"]]).view(np.uint64))) for r in hits]
    want = max(2 * k, 16)
    while meets and want < most:
        depth = {q: max((d for d, n in c.items() if n >= want), default=0) for q, c in counts.items()}
        if np.mean([m >= depth.get(q, 0) for q, m in meets]) >= recall:
            return want
        want = int(want * 1.25) + 1
    return most


def _score_group(k: int):
    def apply(table: pa.Table) -> pa.Table:
        empty = pa.table({"q": pa.array([], pa.int64()), "cls": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        is_q = table.column("is_q").to_numpy()
        cls = table.column("cls").to_numpy()
        if is_q.all() or not is_q.any():
            return empty
        vec, dim = table.column("vec").to_pylist(), table.column("dim")[0].as_py()
        q = np.flatnonzero(is_q)
        e = np.flatnonzero(~is_q)
        e = e[np.argsort(cls[e])]
        entries = _matrix([vec[j] for j in e], dim)
        outs = []
        for at in range(0, len(q), 256):
            part = q[at:at + 256]
            s = _matrix([vec[j] for j in part], dim) @ entries.T
            best = _top(s, k)
            outs.append((np.repeat(cls[part], best.shape[1]), cls[e][best.ravel()], np.take_along_axis(s, best, 1).ravel()))
        a, b, c = (np.concatenate(x) for x in zip(*outs))
        return pa.table({"q": a, "cls": b, "score": c})
    return apply


def nearest(rows: DataFrame, asked: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 20,
            trees: int = 16, recall: float = 0.95, tune: int = 64, want: int | None = None, seed: int = 17) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest found of every row for which ``asked`` holds."""
    members, queries = classes(rows, id_col, vector, k + 1, asked)
    heads = (members.filter("place = 1").select("cls", "v")
             .join(queries.select(F.col("cls").alias("_q")).distinct(), F.col("cls") == F.col("_q"), "left")
             .select("cls", "v", F.col("_q").isNotNull().alias("asked")))
    size = members.filter("place = 1").agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    total, largest = size[0], size[1] or 1.0
    forest = index(heads, largest, trees, seed)
    depths = list(range(0, min(BITS, max(total, 2).bit_length() + 4)))
    node = ["dim", "tree", "depth", "prefix"]
    counts = stage(_nodes(forest, "entry", depths).groupBy(*node).agg(F.count("*").alias("n")), "nodes")
    query_rows = forest.filter("asked")
    reached = stage(_depths(query_rows, counts, depths), "reached")
    if want is None:
        want = tuned(forest, reached, trees * total + 1, k, recall, tune, seed)
    stop = reached.groupBy("cls").agg(F.coalesce(F.max(F.when(F.col("n") >= want, F.col("depth"))), F.lit(0)).alias("stop"))
    stops = stage(query_rows.join(stop, "cls"), "stops")
    used = sorted(r[0] for r in stops.select("stop").distinct().collect())       # at most 64 depths
    lies = _nodes(stops, "query", used or [0], "cls", "vec", "stop").filter("depth = stop").drop("stop")
    plan = (lies.groupBy(*node).agg(F.count("*").alias("nq")).join(counts, node)
            .withColumn("cuts", F.ceil(F.col("n") / ENTRIES).cast("int")).withColumn("chunks", F.ceil(F.col("nq") / QUERIES).cast("int"))
            .select(*node, "cuts", "chunks"))
    plan = stage(plan, "plan")
    key = F.xxhash64("cls", F.lit(seed))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    entries = (_nodes(forest, "entry", used or [0], "cls", "vec").join(plan, node)
               .select(*node, F.pmod(key, F.col("cuts")).cast("int").alias("cut"), spread("chunks").alias("chunk"), F.lit(False).alias("is_q"), "cls", "vec"))
    asks = (lies.join(plan, node)
            .select(*node, spread("cuts").alias("cut"), F.pmod(key, F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("is_q"), "cls", "vec"))
    scored = (entries.unionByName(asks).groupBy(*node, "cut", "chunk")
              .applyInArrow(_score_group(k + 1), "q long, cls long, score double"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "cls")
    scored = stage(scored.groupBy("q", "cls").agg(F.max("score").alias("score"))
                   .withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r"), "scored")
    # Members of the nearest classes, then the queries of each query class.
    near = Window.partitionBy("qc").orderBy(F.desc("score"), "id")
    listed = (scored.withColumnRenamed("q", "qc").join(members.select("cls", "id"), "cls")
              .withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1).select("qc", "id", "score"))
    mine = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return (queries.select("q", F.col("cls").alias("qc")).join(listed, "qc").filter("id <> q")
            .withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= k)
            .select(F.col("q").alias("query_id"), "rank", F.col("id").alias(id_col), "score"))
