import math
from collections import Counter

from delayrisk.llm import mixing


def brute_targets(sizes):
    """sizes in source order: shares by weight, excess reshared until none is above twice its size."""
    weight = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    left, out, open_ = 1.5 * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        w = sum(weight[k] for k in open_)
        full = {k for k in open_ if weight[k] * left / w >= 2 * sizes[k]}
        if not full:
            for k in open_:
                out[k] = weight[k] * left / w
            break
        for k in full:
            out[k] = 2.0 * sizes[k]
            left -= out[k]
        open_ -= full
    return out


def test_targets(spark):
    sizes = {"a": 100, "b": 7, "c": 5000, "d": 0, "é": 40, "Z": 900, None: 60}
    rows = spark.createDataFrame(list(sizes.items()), "source string, words long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    order = ["Z", "a", "b", "c", "d", "é", None]
    want = brute_targets([sizes[s] for s in order])
    assert all(math.isclose(got[s], w) for s, w in zip(order, want))
    assert math.isclose(sum(got.values()), 1.5 * sum(sizes.values()))


def test_taken_words_come_near_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert r.size * math.floor(r.target / r.source_size) <= r.taken <= min(2, math.ceil(r.target / r.source_size)) * r.size
        by.setdefault(r.source, [0, r.target, 0])[0] += r.taken
        by[r.source][2] = max(by[r.source][2], r.size)
    for taken, target, largest in by.values():
        assert abs(taken - target) <= largest
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.taken) for r in rows) == Counter((r.doc_id, r.taken) for r in again)


def test_emit_is_the_mix(odd):
    mixed = mixing.mix(odd).collect()
    out = mixing.emit(odd)
    assert out.columns == odd.columns
    got = Counter((r.doc_id, r.source, r.text) for r in out.collect())
    assert sum(got.values()) == sum(r.copies for r in mixed)
    words = Counter()
    for (i, s, t), n in got.items():
        words[i, s] += n * len((t or "").encode().split())
    want = Counter()
    for r in mixed:
        want[r.doc_id, r.source] += r.taken
    assert +words == +want


def test_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.taken == 0 for r in rows if r.size == 0) and any(r.source is None for r in rows)


def test_empty(spark, empty):
    assert mixing.mix(empty).count() == 0 and mixing.emit(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", None, 0)], empty.schema)
    assert [(r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0.0, 0), (0.0, 0)]
