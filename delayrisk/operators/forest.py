"""Random forest whose trees depend on the rows alone, kept as a node table (M3-M6).

``pyspark.ml`` draws its bootstrap weights per partition, so the same rows dealt otherwise
give other trees.  Here every choice is a function of the data or of a
hash: a row's weight in a tree (Poisson with mean 1, as a bootstrap has it) comes from its id
and the tree, a node's three candidate features from the seed and the node, and the cut points of a
feature are exact quantiles.  Weights are whole numbers, so their sums don't depend on any
order either: equal rows give the equal forest on any partitioning, after any retry.

A level of all trees takes one pass: tasks count weights by (tree, node, feature, bin, class), and only
that table, bounded by trees, depth, features and bins, reaches the driver, which picks the splits.
The fitted forest is a table of nodes.  Scoring compiles it to one
Column expression, so a scored plan has no Python and no model object, and SQL can walk the same table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ID
from .features import FEATURES
from .labels import DELAYED, ON_TIME
from .model import DEPTH, LABEL, SEED, TREES
from .stats import quantiles

BINS = 32
CANDIDATES = 3  # features tried per node, the square root of five rounded up
#: A byte below the k-th bound weighs k: Poisson with mean 1 in 256ths.
BOUNDS = (94, 188, 235, 251, 255)
PER_HASH = 16  # trees served by one md5

NODES = "tree int, node int, feature string, cut double, late long, timely long"


@dataclass(frozen=True)
class Node:
    """A node of a tree: root 1, children 2k (values up to the cut) and 2k + 1; without a feature, a leaf.

    ``late`` and ``timely`` are the weights of the two classes that reached it.
    """
    tree: int
    node: int
    feature: str | None
    cut: float | None
    late: int
    timely: int


def number(feature: str) -> Column:
    """A feature as the forest reads it: a double, null as 0."""
    return F.coalesce(F.col(feature).cast("double"), F.lit(0.0))


def cut_points(rows: DataFrame, features: Sequence[str] = FEATURES, bins: int = BINS) -> dict[str, list[float]]:
    """Distinct exact quantiles of each feature, at 1/bins, 2/bins and so on."""
    numbers = rows.select(*[number(f).alias(f) for f in features])
    return {f: sorted(set(quantiles(numbers, f, [k / bins for k in range(1, bins)]))) for f in features}


def candidates(seed: int, tree: int, node: int, features: Sequence[str]) -> list[int]:
    """Places of the features that a node may split on."""
    order = sorted(range(len(features)), key=lambda k: hashlib.md5(f"{seed}:{tree}:{node}:{k}".encode()).hexdigest())
    return sorted(order[:CANDIDATES])


def _histogram(rows: DataFrame, trees: list[dict], cuts: list[list[float]], level: int) -> dict:
    """{(tree, node, feature): weights by (bin, class)} of the nodes of one level."""
    bins = max(map(len, cuts)) + 1
    width, k = 1 << level, len(cuts)
    table = np.searchsorted(np.array(BOUNDS), np.arange(256), "right").astype(np.float64)
    edges = [np.array(c) for c in cuts]

    def walk(x, tree):
        """The node each row has come to; 0 once it is in a leaf above the open level."""
        at = np.ones(len(x), np.int64)
        for _ in range(level):
            new = np.zeros_like(at)
            for node, (f, cut) in tree.items():
                here = at == node
                new[here] = 2 * node + (x[here, f] > cut)
            at = new
        return at

    def apply(batches):
        total = np.zeros(len(trees) * width * k * bins * 2)
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([b.column(f).to_numpy(zero_copy_only=False) for f in range(k)])
            place = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
            label = b.column(k).to_numpy(zero_copy_only=False).astype(np.int64)
            weights = table[np.frombuffer(b"".join(b.column(k + 1).to_pylist()), np.uint8).reshape(b.num_rows, -1)]
            for t, tree in enumerate(trees):
                node = walk(x, tree) - width
                used = (node >= 0) & (weights[:, t] > 0)
                for f in range(k):
                    key = (((t * width + node[used]) * k + f) * bins + place[used, f]) * 2 + label[used]
                    total += np.bincount(key, weights[used, t], len(total))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full].astype(np.int64))], names=["key", "n"])
    counts = rows.mapInArrow(apply, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    out = np.zeros(len(trees) * width * k * bins * 2, np.int64)
    for r in counts.collect():  # bounded by the forest's shape
        out[r["key"]] = r["n"]
    return {(t, width + n, f): h for t, x in enumerate(out.reshape(len(trees), width, k, bins, 2)) for n, y in enumerate(x) for f, h in enumerate(y)}


def _purity(late: int, timely: int) -> float:
    return (late * late + timely * timely) / (late + timely)


def best_split(hists: dict, tree: int, node: int, cuts: list[list[float]], tried: list[int]) -> tuple[int, float] | None:
    """(feature, cut) of the purest split of a node by Gini, ties to the smaller feature, then cut; None if none is purer than the node."""
    late, timely = (int(v) for v in hists[tree, node, 0].sum(0))
    best, best_at = _purity(late, timely) if late + timely else 0.0, None
    for f in tried:
        left = np.cumsum(hists[tree, node, f], 0)
        for b, cut in enumerate(cuts[f]):
            a, c = int(left[b, 0]), int(left[b, 1])
            if not 0 < a + c < late + timely:
                continue
            gain = _purity(a, c) + _purity(late - a, timely - c)
            if gain > best:
                best, best_at = gain, (f, cut)
    return best_at


def fit(train: DataFrame, features: Sequence[str] = FEATURES, trees: int = TREES, depth: int = DEPTH, seed: int = SEED,
        label: str = LABEL, key: str = ID) -> list[Node]:
    """Fit the forest on rows with features, label and id; read ``depth`` + 1 times, so give a staged table."""
    cuts = list(cut_points(train, features).values())
    hashes = F.concat(*[F.unhex(F.md5(F.concat(F.lit(f"{seed}:{k}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
                        for k in range(-(-trees // PER_HASH))])
    rows = train.filter(F.col(label).isNotNull()).select(
        *[number(f).alias(f"f{k}") for k, f in enumerate(features)], (F.col(label) != DELAYED).cast("int").alias("y"), hashes.alias("bag"))
    splits: list[dict] = [{} for _ in range(trees)]
    nodes = []
    for level in range(depth + 1):
        hists = _histogram(rows, splits, cuts, level)
        new: list[dict] = [{} for _ in range(trees)]
        for t in range(trees):
            for n in range(1 << level, 2 << level):
                late, timely = (int(v) for v in hists[t, n, 0].sum(0))
                if not late + timely and level:
                    continue
                at = best_split(hists, t, n, cuts, candidates(seed, t, n, features)) if level < depth else None
                if at:
                    new[t][n] = at
                nodes.append(Node(t, n, features[at[0]] if at else None, at[1] if at else None, late, timely))
        for t in range(trees):
            splits[t].update(new[t])
    return nodes


def _share(n: Node) -> float:
    return n.late / (n.late + n.timely) if n.late + n.timely else 0.5


def risk(nodes: Sequence[Node]) -> Column:
    """100 times the mean, over the trees, of the leaf's share of 'Delayed'; one expression of comparisons."""
    table = {(n.tree, n.node): n for n in nodes}

    def branch(t: int, k: int) -> Column:
        n = table[t, k]
        if n.feature is None:
            return F.lit(_share(n))
        return F.when(number(n.feature) > F.lit(n.cut), branch(t, 2 * k + 1)).otherwise(branch(t, 2 * k))
    trees = sorted({n.tree for n in nodes})
    total = branch(trees[0], 1)
    for t in trees[1:]:
        total = total + branch(t, 1)
    return total / F.lit(float(len(trees))) * F.lit(100.0)


def score(df: DataFrame, nodes: Sequence[Node], label: str = LABEL) -> DataFrame:
    """M4-M6 by the node table: class ('Delayed' from a risk of 50 on) and risk factor."""
    keep = [c for c in df.columns if c != label]
    out = df.select(*keep, risk(nodes).alias("risk_factor"))
    return out.select(*keep, F.when(F.col("risk_factor") >= 50, DELAYED).otherwise(ON_TIME).alias(label), "risk_factor")


def node_table(spark: SparkSession, nodes: Sequence[Node]) -> DataFrame:
    """The forest as rows; bounded by its shape."""
    return spark.createDataFrame([tuple(asdict(n).values()) for n in nodes], NODES)


def from_table(table: DataFrame) -> list[Node]:
    return [Node(**r.asDict()) for r in table.orderBy("tree", "node").collect()]
