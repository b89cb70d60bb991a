import random

import numpy as np
from pyspark.sql import functions as F

from delayrisk.llm import prefix_forest as P
from delayrisk.llm.queries import op1_hash_prefix_forest


def brute(rows, k=20, every=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v)
          and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    ok = list({(i, v.tobytes()): (i, v) for i, v in ok}.values())
    out = {}
    for q, x in ok:
        if q % every == 0:
            near = sorted((-float(x @ v), i) for i, v in ok if i != q and len(v) == len(x))[:k]
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return out


def collect(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(x) for q, x in got.items()}


def recall(got, want):
    return np.mean([len({i for _, i, _ in got.get(q, [])} & {i for _, i, _ in w}) / max(len(w), 1) for q, w in want.items()])


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = collect(op1_hash_prefix_forest(spark, sf)), brute(rows)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    scores = {(q, i): s for q, w in brute(rows, k=10**6).items() for _, i, s in w}
    for q, near in got.items():
        assert [r for r, _, _ in near] == list(range(1, 21))
        assert all(abs(s - scores[q, i]) < 1e-12 for _, i, s in near)


def test_clusters_need_few_entries(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16)) * 3
    x = centres[rng.integers(0, 40, 2000)] + 0.1 * rng.standard_normal((2000, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collect(P.nearest(docs, F.col("vec_id") % 20 == 0, trees=16))
    assert recall(got, brute(rows)) >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(60)]
    rows += [(100, [1.0, 0.0, 0.0, 0.0]), (120, [1.0, 0.0, 0.0, 0.0]), (140, [1.0, 0.0, 0.0, 0.0]), (140, [1.0, 0.0, 0.0, 0.0]), (160, [2.0, 0.0, 0.0, 0.0])]
    rows += [(200, None), (220, []), (240, [0.0, 0.0, 0.0, 0.0]), (260, [nan, 1.0, 1.0, 1.0]), (280, [inf, 1.0, 1.0, 1.0]), (300, [None, 1.0, 1.0, 1.0]),
             (None, [1.0, 1.0, 1.0, 1.0]), (320, [1.0, 2.0]), (340, [3.0, -0.0]), (341, [5.0, 0.0])]
    docs = spark.createDataFrame([r + ("x", "y", "z") for r in rows],
                                 "vec_id long, embedding array<double>, cls string, code string, depth string")
    got, want = collect(P.nearest(docs, F.col("vec_id") % 20 == 0, want=10**9)), brute(rows)
    assert got.keys() == {q for q, w in want.items() if w}
    for q, near in got.items():
        assert [(r, i) for r, i, _ in near] == [(r, i) for r, i, _ in want[q]]
        assert np.allclose([s for *_, s in near], [s for *_, s in want[q]])


def test_a_hot_vector_and_small_groups(spark, monkeypatch):
    """A third of all rows alike; nodes are cut into many groups."""
    monkeypatch.setattr(P, "ENTRIES", 16)
    monkeypatch.setattr(P, "QUERIES", 3)
    rng = np.random.default_rng(5)
    hot = rng.standard_normal(8)
    rows = [(k, (hot if k % 3 == 0 else rng.standard_normal(8)).tolist()) for k in range(400)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = collect(P.nearest(docs, F.col("vec_id") % 20 == 0, want=10**9)), brute(rows)
    assert {q: [i for _, i, _ in x] for q, x in got.items()} == {q: [i for _, i, _ in x] for q, x in want.items()}


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert P.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    assert P.nearest(spark.createDataFrame([(20, [1.0])], schema), F.col("vec_id") % 20 == 0).count() == 0
    two = collect(P.nearest(spark.createDataFrame([(20, [1.0]), (3, [-2.0])], schema), F.col("vec_id") % 20 == 0))
    assert two == {20: [(1, 3, -2.0)]}


def test_prefixes_follow_the_strings():
    x = np.random.default_rng(1).standard_normal((50, 6))
    c = P.codes(x, np.zeros(50), 3, 1)
    signs = (np.column_stack((x, np.zeros(50))) @ P.planes(6, 3, 1) > 0).reshape(50, 3, 64)
    order = np.argsort(c[:, 0], kind="stable")
    assert [tuple(s) for s in signs[order, 0]] == sorted(map(tuple, signs[:, 0]))
