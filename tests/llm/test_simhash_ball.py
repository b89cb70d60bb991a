import random

import pyarrow as pa
import xxhash

from delayrisk.llm import components as C
from delayrisk.llm import simhash_ball as S
from delayrisk.llm.common import arrow_map
from delayrisk.llm.components import components
from delayrisk.session import BATCH_BYTES


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    runs = [words] if len(words) < 3 else [words[k:k + 3] for k in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=2):
    """{fingerprint: smallest fingerprint of its component}, comparing all pairs."""
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    every = sorted(prints)
    for a in every:
        for b in every:
            if a < b and (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in every}


def check(docs):
    rows = docs.collect()
    got = S.near_duplicates(docs).collect()
    f = {(r.doc_id, r.text): brute_fingerprint(r.text) for r in rows}
    root = brute_components(set(f.values()))
    low = {}
    for (i, _), x in f.items():
        r = root[x]
        low[r] = i if low.get(r) is None else min(low[r], i) if i is not None else low[r]
    want = sorted((str(r.doc_id), f[r.doc_id, r.text], str(low[root[f[r.doc_id, r.text]]])) for r in rows)
    assert sorted((str(g.doc_id), g.fingerprint % (1 << 64), str(g.component_id)) for g in got) == want


def test_matches_brute_force(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))


def test_odd_rows(odd):
    check(odd)


def test_links_join_everything_in_the_radius(spark):
    rng = random.Random(1)
    prints = set()
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(12):
            prints.add(f)
            for b in rng.sample(range(64), rng.choice((1, 2, 3))):
                f ^= 1 << b
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in prints]
    distinct = spark.createDataFrame(signed, "f long")
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in components(S.links(distinct)).collect()}
    want = brute_components(prints)
    mine = {}
    for f in prints:
        mine.setdefault(roots.get(f, f), set()).add(f)
    theirs = {}
    for f, r in want.items():
        theirs.setdefault(r, set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_a_long_chain(spark):
    links = spark.range(400).selectExpr("id AS u", "id + 1 AS v")
    assert {r.root for r in components(links).collect()} == {0}


def test_keep_one(odd, odd_rows):
    kept = S.keep_one(odd)
    assert kept.columns == odd.columns
    groups = S.near_duplicates(odd).select("component_id").distinct().count()
    assert kept.count() == groups
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) <= {r.component_id for r in S.near_duplicates(odd).collect()}


def test_empty(empty):
    assert S.near_duplicates(empty).count() == 0
    assert S.keep_one(empty).count() == 0


def test_few_texts_are_held_at_once(spark, monkeypatch):
    """A batch of many texts is worked on a slice at a time."""
    texts = [None, "", *[f"word{k} " * 40_000 for k in range(12)], "end"]
    monkeypatch.setattr(S, "arrow_map", lambda df, fn, schema: fn)
    apply = S.fingerprints(spark.createDataFrame([(1, "a")], "i long, text string"))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "text"])
    parts = list(apply([batch]))
    assert len(parts) > 2 and [i for p in parts for i in p.column("i").to_pylist()] == [*range(len(texts))]
    got = [f % (1 << 64) for p in parts for f in p.column("fingerprint").to_pylist()]
    assert got == [S.fingerprint(t) for t in texts]


def test_texts_reach_workers_by_bytes(spark):
    """A batch's size follows the texts' bytes, not only their number."""
    texts = spark.range(24, numPartitions=1).selectExpr("id", "repeat('words and ', 100000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])
    spark.conf.unset(BATCH_BYTES)
    found = arrow_map(texts, sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in found) == 24
    assert max(r["bytes"] for r in found) < 6 << 20


def test_few_links_are_staged_as_one_part(spark, monkeypatch):
    """Each round's links are written in parts by their number, not one for each part of a shuffle."""
    parts = []
    monkeypatch.setattr(C, "stage", lambda df, label, own=C.stage: (parts.append(df.rdd.getNumPartitions()), own(df, label))[1])
    links = spark.range(40).selectExpr("id AS u", "id + 1 AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for part, most in ((C.PART, 1), (16, 8)):
            parts.clear()
            monkeypatch.setattr(C, "PART", part)
            assert sorted(map(tuple, components(links).collect())) == [(k, 0) for k in range(1, 41)]
            assert len(parts) > 2 and max(parts[1:]) <= most
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
