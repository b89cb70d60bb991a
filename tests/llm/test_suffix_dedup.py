import random

import pyarrow as pa

import numpy as np

from delayrisk.llm import suffix_dedup as S

from .conftest import sentence


def brute(rows):
    """{(id, start, end)}: stretches in which every 50 words also stand in another row."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    where = {}
    for k, (_, w) in enumerate(words):
        for s in range(len(w) - 49):
            where.setdefault(tuple(w[s:s + 50]), set()).add(k)
    out = set()
    for k, (i, w) in enumerate(words):
        now = None
        for s in range(len(w) - 49):
            if len(where[tuple(w[s:s + 50])]) > 1:
                if now and s <= now[1]:
                    now[1] = s + 50
                else:
                    if now:
                        out.add((i, *now))
                    now = [s, s + 50]
        if now:
            out.add((i, *now))
    return out


def check(docs):
    got = [(r.doc_id, r.start_word, r.end_word) for r in S.repeats(docs).collect()]
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert set(got) == want and len(got) == len(want)


def test_matches_brute_force(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_planted_passages_of_every_length(spark):
    rng = random.Random(7)
    rows = []
    shared = {n: sentence(rng, n, 10**6) for n in range(44, 90)}
    for n, p in shared.items():
        for _ in range(3):
            before, after = (sentence(rng, rng.randrange(0, 40), 10**6) for _ in range(2))
            rows.append((len(rows), f"{before} {p}\n{after}"))
    for _ in range(30):      # pieces of shared passages in other surroundings, and copies of copies
        a, b = (rng.choice(list(shared.values())).split() for _ in range(2))
        rows.append((len(rows), " ".join(a[:rng.randrange(len(a))] + b[rng.randrange(len(b)):])))
        rows.append((len(rows), rng.choice(rows)[1]))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_few_words_and_inner_repetition(spark):
    rng = random.Random(8)
    rows = [(k, sentence(rng, 300, 2)) for k in range(12)]
    rows += [(20, "ha " * 500), (21, "ha " * 200), (22, "only here " * 100)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_a_hot_passage_over_many_parts(spark):
    rng = random.Random(9)
    hot = sentence(rng, 70, 10**6)
    rows = [(k, f"{sentence(rng, 30, 10**6)} {hot} {sentence(rng, 30, 10**6)}" if k % 3 else sentence(rng, 80, 10**6)) for k in range(300)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "61")
        check(spark.createDataFrame(rows, "doc_id long, text string"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_odd_rows(odd, empty):
    got = {(r.doc_id, r.start_word, r.end_word) for r in S.repeats(odd).collect()}
    assert got == {(5, 0, 120), (6, 0, 120), (7, 0, 120), (None, 0, 120)}
    assert S.repeats(empty).count() == 0


def test_selection_is_by_content():
    rng = random.Random(1)
    core = [f"w{rng.random()}".encode() for _ in range(200)]
    h = S.Hashes(core)
    at = S.selected(h)
    more = S.selected(S.Hashes([b"x"] * 37 + core))
    assert np.array_equal(at + 37, more[37:])
    assert np.all(at - np.arange(len(at)) < S.SPREAD)


def test_hashes_are_kept_where_parts_meet_alone():
    """Rows inside a part are stored without their hashes; its first and last row have them."""
    batch = pa.RecordBatch.from_pydict({"a": [1, 1, 2, 2, 2, 3], "b": [5, 5, 6, 6, 7, 8], "d": [1, 2, 3, 4, 5, 6], "at": [0] * 6})
    rows = [r for b in S._compare([batch.slice(0, 2), batch.slice(2)]) for r in b.to_pylist()]
    assert [(r["a"], r["b"], r["d"], r["alike"], r["edge"]) for r in rows] == [
        (1, 5, 1, True, 1), (None, None, 2, True, 0), (None, None, 3, True, 0), (None, None, 4, True, 0), (None, None, 5, False, 0), (3, 8, 6, False, 2)]


def test_neighbours_give_places_alone(spark):
    rows = spark.createDataFrame([(1, 5, k, 0) for k in range(40)], "a long, b long, d long, at int").repartition(3)
    got = S.neighbours(rows)
    assert got.columns == ["d", "at", "alike"] and got.filter("alike").count() == 40
