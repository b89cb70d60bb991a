import hashlib
import math
from collections import defaultdict

import numpy as np

from delayrisk.llm import vantage_kmeans as V


def brute(rows, k=40, rounds=5, dims=64):
    """[(id, cluster, distance)], centroids: every distance in Python integers."""
    kept = [(i, [math.floor(256 * float(x)) if abs(x) < 1e300 else int(x) * 256 for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        cents = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if groups[n] else c for n, c in enumerate(cents)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], cents


def check(spark, rows, schema="vec_id long, embedding array<double>", **args):
    out, cents = V.cluster(spark.createDataFrame(rows, schema).repartition(3), **args)
    fit = lambda d: d if d is not None and d < 1 << 63 else None
    want, brute_cents = brute([r[:2] for r in rows], **{k: v for k, v in args.items() if k in ("k", "rounds", "dims")})
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(((i, c, fit(d)) for i, c, d in want), key=key)
    assert [[int(v) for v in c] for c in cents] == brute_cents
    return want


def test_matches_brute_force_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.integers(-3, 4, 4) / 64).tolist()) for k in range(300)]  # coarse: many ties and repeats
    rows += [rows[0], rows[0], (1, None), (2, [1.0]), (3, [0.1, None, 0.2, 0.3]), (4, [float("nan"), 0.0, 0.0, 0.0]),
             (5, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5, 0.25, -0.5, 1.0]), (6, [])]
    extra = "vec_id long, embedding array<double>, i long, v string, cluster string, distance string"
    check(spark, [r + (1, "x", "y", "z") for r in rows], extra, k=12, dims=4)


def test_very_large_components_stay_exact(spark):
    rows = [(k, [float(k) * 10.0 ** (k % 40), -1e300 if k == 7 else 0.25 * k]) for k in range(30)] + [(99, [1.7e308, 0.0])]
    check(spark, rows, k=5, dims=2, rounds=3)


def test_a_hot_vector_and_few_rows(spark):
    hot = [0.25] * 3
    check(spark, [(k, hot if k % 3 else [k / 100, -k / 50, 0.5]) for k in range(200)], k=9, dims=3)
    check(spark, [(1, hot), (2, hot)], k=9, dims=3)
    none, cents = V.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert none.count() == 0 and len(cents) == 0 and V.with_inertia(none, cents).count() == 0


def test_search_prunes_and_keeps_ties():
    rng = np.random.default_rng(4)
    cents = np.repeat(rng.integers(-200, 200, (20, 3)), 2, 0).astype(float)  # each twice: every answer is a tie
    x = rng.integers(-200, 200, (500, 3)).astype(float)
    who, d, computed = V.search(V.build(cents), cents, x)
    every = V.squared(x, cents)
    assert (who == every.argmin(1)).all() and (d == every.min(1)).all()
    assert computed < 0.7 * every.size


def test_inertia_and_centroid_digest(spark):
    rows = [(k, [k / 8, 1.0]) for k in range(20)]
    out, cents = V.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, dims=2)
    want, brute_cents = brute(rows, k=3, dims=2)
    for r in V.with_inertia(out, cents).collect():
        assert r.inertia == sum(d for *_, d in want)
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, brute_cents[r.cluster])).encode()).hexdigest()
