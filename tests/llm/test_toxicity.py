import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from delayrisk.llm import toxicity as T

from .conftest import sentence

BAD = ["vile", "rotten", "scummy"]


def corpus(spark, n=400, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        words = sentence(rng, rng.randrange(15, 80)).split()
        toxic = k % 5 == 0
        if toxic:
            for _ in range(max(2, len(words) // 15)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = T.fit(docs, labels, train=F.col("doc_id") % 4 != 2)
    got = T.score(docs, model).join(labels, "doc_id").filter("doc_id % 4 = 2").collect()
    assert np.mean([(r.score >= 0.3) == (r.toxic == 1) for r in got]) > 0.9


def test_every_labelled_row_counts(spark):
    """max_rows bounds the curve alone; the counts are those of a brute-force pass over all other rows."""
    docs, labels = corpus(spark)
    hashed = labels.withColumn("curve", F.expr("pmod(xxhash64(doc_id, 11), 4) = 0"))
    rows = docs.join(hashed, "doc_id").filter("not curve").collect()
    triples = {(r.toxic, u, a, b) for r in rows for ws in [T.words(r.text)] for u, a, b in zip(["", ""] + ws, [""] + ws, ws)}
    pairs = Counter((y, a, b) for y, _, a, b in triples)
    uni = Counter((y, b) for y, a, b in pairs)
    kept = {(a, b) for (y, a, b), n in pairs.items() if n > 2}
    sample = docs.join(labels, "doc_id").join(hashed.filter("not curve"), "doc_id", "left_semi").select(F.col("toxic").alias("y"), F.col("text").alias("t"))
    c = T.count(sample, 4.0, 2.0)
    vocab = {b for (y, b), n in uni.items() if n > 4} | {w for p in kept for w in p}
    vocab = [w for _, w in sorted((int(T.hashes([w])[0]), w) for w in vocab)]
    assert c.vocab.tolist() == T.hashes(vocab).tolist()
    assert c.uni.tolist() == [[uni[y, w] for w in vocab] for y in (1, 0)]
    assert (c.uni.sum(1) + c.rest).tolist() == [max(sum(n for (y, _), n in uni.items() if y == k), c.uni[1 - k].sum() + 1) for k in (1, 0)]
    at = {w: k for k, w in enumerate(vocab)}
    assert c.pair.tolist() == sorted(at[a] * (len(at) + 1) + at[b] for a, b in kept)
    few, many = (T.fit(docs, labels, max_rows=m, pair_discount=2.0) for m in (30, 3000))
    assert few.vocab.tolist() == many.vocab.tolist() == c.vocab.tolist() and np.allclose(few.p, many.p) and np.allclose(few.pair_p, many.pair_p)


def test_reruns_agree_and_ids_do_not_matter(spark):
    docs, labels = corpus(spark, 120)
    a, b = T.fit(docs, labels), T.fit(docs.repartition(5), labels.repartition(4))
    t = docs.first().text
    assert a.score(t) == b.score(t)
    moved = T.score(docs.withColumn("doc_id", F.col("doc_id") + 1000), a)
    assert {r.text: r.score for r in moved.collect()} == {r.text: r.score for r in T.score(docs, a).collect()}


def test_probabilities_sum_to_one():
    """Unigram level over the vocabulary and the rest; pairs and what they leave to that level."""
    c = T.Counts(np.sort(T.hashes("abc")), np.array([[9.0, 6, 1], [8, 2, 5]]), np.array([4.0, 3]), np.array([[30, 0, 9], [20, 10, 0]]),
                 np.array([0 * 4 + 1, 0 * 4 + 2]), np.array([[20, 3], [12, 1]]))
    m = T.kneser_ney(c, 2.0, 2.0, 0.1)
    assert np.allclose(m.p.sum(1), 1)
    after_a = m.back[:, [0]] * m.p
    after_a[:, 1] += m.pair_p[:, 0]
    after_a[:, 2] += m.pair_p[:, 1]
    assert np.allclose(after_a.sum(1), 1)


def test_parts_drop_repeats_alone(spark, monkeypatch):
    """N-grams are the same in parts of any size, also where a text goes over a part's end."""
    import pyarrow as pa
    docs, labels = corpus(spark, 40)
    rows = docs.join(labels, "doc_id").collect()
    batch = pa.RecordBatch.from_pydict({"y": [r.toxic for r in rows], "t": [r.text for r in rows]})
    triples = lambda: {tuple(x.values()) for b in T._triples([batch]) for x in b.to_pylist()}
    whole = triples()
    for n in (1, 7, 100):
        monkeypatch.setattr(T, "PART", n)
        assert triples() == whole
    assert len(whole) == len({(r.toxic, *x) for r in rows for ws in [T.words(r.text)] for x in zip(["", ""] + ws, [""] + ws, ws)})


def test_blocks_do_not_change_a_score(spark, monkeypatch):
    docs, labels = corpus(spark, 120)
    model = T.fit(docs, labels)
    text = " ".join(r.text for r in docs.collect())
    whole = model.ratio(text)
    monkeypatch.setattr(T, "BLOCK", 7)
    assert np.allclose(model.ratio(text), whole)


def test_odd_rows(spark, odd):
    docs, labels = corpus(spark, 120)
    got = T.score(odd, T.fit(docs, labels))
    assert got.columns[:-1] == odd.columns and got.columns[-1] == "_score"      # "score" is taken
    rows = got.collect()
    assert len(rows) == odd.count() and all(0 <= r["_score"] <= 1 for r in rows)
    assert len({r["_score"] for r in rows if not (r.text or "").strip()}) == 1


def test_the_curve_never_falls():
    """Few rows that say the opposite by chance leave the share of label 1, not a falling curve."""
    x = np.array([[0.5, 0.1], [0.4, -0.2], [-0.3, 0.1], [-0.5, -0.1], [-0.4, 0.0]])
    y = np.array([0.0, 0, 1, 1, 0])
    curve = T.fit_curve(x, y)
    assert curve[1] == 0 and curve[2] >= 0
    up = T.fit_curve(x, 1 - y)
    assert up[1] > 0


def test_labels_missing(spark, empty):
    docs, labels = corpus(spark, 40)
    none = T.fit(docs, labels.filter("false"))
    assert none.score("vile") == 0.0
    assert T.fit(docs, labels.filter("toxic = 1")).score("anything") == 1.0
    assert T.score(empty, none).count() == 0
    odd_labels = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    assert T.fit(docs, odd_labels).score("x") == 0.0


def test_labels_by_bitmap_are_those_of_a_join(spark, monkeypatch):
    """Ids that share a place with other labels or unlabelled ids get their own label; only they are joined."""
    docs, labels = corpus(spark, 300)
    texts = docs.union(docs.limit(20)).union(spark.createDataFrame([(None, "no id")], docs.schema)).toDF("i", "t")
    rows = labels.filter("doc_id % 3 <> 0").toDF("i", "y")
    want = Counter(map(tuple, texts.join(rows, "i").select("y", "t").collect()))
    for bits in (64, 1 << 10, 1 << 20):
        monkeypatch.setattr(T, "BITS", bits)
        assert Counter(map(tuple, T._labelled(texts, rows).collect())) == want


def test_no_stage_holds_two_python_workers_a_task(spark, monkeypatch):
    """Texts at doubtful places are joined before they are counted; that map and the one that found them stay apart."""
    docs, labels = corpus(spark, 300)
    monkeypatch.setattr(T, "BITS", 1 << 10)
    monkeypatch.setattr(T, "arrow_map", lambda df, fn, schema, own=T.arrow_map: (plans.append(
        df._jdf.queryExecution().optimizedPlan().toString()), own(df, fn, schema))[1])
    plans = []
    then = lambda batches: (b.select(["y"]) for b in batches)
    got = T._labelled(docs.toDF("i", "t"), labels.filter("doc_id % 3 <> 0").toDF("i", "y"), then, "y int")
    assert got.count() == 200
    assert len(plans) == 4 and not any("MapInArrow" in p for p in plans)


def test_packed_counts_do_not_depend_on_frequent_words(spark, monkeypatch):
    """Words of two bytes, hashed words and both mixed give the same counts, in parts of any size."""
    docs, labels = corpus(spark, 120)
    sample = docs.join(labels, "doc_id").select(F.col("toxic").alias("y"), F.col("text").alias("t"))
    frequent = T.frequent_words(sample)
    assert len(frequent) > 100
    whole = T.count(sample, 4.0, 2.0)
    for part, known in ((7, frequent[::3]), (1 << 18, frequent)):
        monkeypatch.setattr(T, "PART", part)
        got = T.count(sample, 4.0, 2.0, known)
        assert all(np.array_equal(getattr(got, f), getattr(whole, f)) for f in ("vocab", "uni", "rest", "hist", "pair", "pair_n"))
    batch = pa.RecordBatch.from_pydict({"y": [r.y for r in sample.collect()], "t": [r.t for r in sample.collect()]})
    size = lambda words: sum(b.nbytes for b in T.Packing(words, 64).pack([batch]))
    assert 2 * size(frequent) < size(frequent[:0])


def test_labels_and_packing_share_a_worker(spark, monkeypatch):
    """No map follows another in a stage: every one would hold a Python worker of its own."""
    docs, labels = corpus(spark)
    before, plain = [], T.arrow_map

    def noted(df, fn, schema):
        before.append((str(schema), df._jdf.queryExecution().optimizedPlan().toString()))
        return plain(df, fn, schema)
    monkeypatch.setattr(T, "arrow_map", noted)
    T.fit(docs, labels)
    packed = [plan for schema, plan in before if schema.startswith("part int")]
    assert packed and "MapInArrow" not in packed[0]
