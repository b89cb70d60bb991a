import hashlib
import random
import re

from pyspark.sql import functions as F

from delayrisk.llm import fingerprints as P
from delayrisk.llm.queries import op9_fingerprints

SF = "/root/testdata/sf0.001"


def edited(rows):
    """[(id, text, edited, next text)] over distinct (id, text) in ascending order."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        n = len(t) // 4
        out.append((i, t, t[:len(t) - n] + nxt[:n], nxt))
    return out


def test_query_against_python(spark):
    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in op9_fingerprints(spark, SF).collect()}
    assert len(got) == len(texts)
    prints = {}
    for i, t, e, nxt in edited(texts):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        a, b = int(r.fingerprint, 16), int(r.edited_fingerprint, 16)
        assert r.near_edited == 1 - (a ^ b).bit_count() / 64
    for i, t, _, nxt in edited(texts):
        assert got[i].near_next == 1 - (int(prints[t], 16) ^ int(prints[nxt], 16)).bit_count() / 64
    every = [int(f, 16) for f in {r.fingerprint for r in got.values()}]
    for r in got.values():
        n = sum((int(r.fingerprint, 16) ^ f).bit_count() <= 3 for f in every)
        assert r.n_near == (n if r.doc_id % 100 == 0 else None)
    near, far = ([getattr(r, c) for r in got.values() if r.n_chars > 200] for c in ("near_edited", "near_next"))
    assert sum(near) / len(near) > 0.7 > 0.6 > sum(far) / len(far)


def test_votes_against_brute_force(spark):
    """A term's weighted votes on every bit, from Spark's own hash of each word pair."""
    text = "the cat sat on the cat sat, ÉTÉ the"
    words = text.split()
    pairs = [(a, b) for a, b in zip(words, words[1:] + [None])]
    h = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()
    votes = [0] * 64
    for r in h:
        w = len(r.a) + len(r.b or "")
        for b in range(64):
            votes[b] += w if r.h >> b & 1 else -w
    want = sum(1 << b for b in range(64) if votes[b] > 0)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert P.fingerprints(docs, ["doc_id"], "text").first().fingerprint % (1 << 64) == want


def test_search_finds_all_within_the_radius(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    every = set(base)
    for f in base:
        for k in range(1, 6):
            x = f
            for b in rng.sample(range(64), k):
                x ^= 1 << b
            every.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    index = spark.createDataFrame([(signed(f),) for f in every], "f long")
    queries = spark.createDataFrame([(signed(f),) for f in base], "q long")
    got = {(r.q % (1 << 64), r.f % (1 << 64)) for r in P.within(queries, index).collect()}
    assert got == {(q, f) for q in base for f in every if (q ^ f).bit_count() <= 3}


def test_odd_rows(odd):
    got = P.compare(odd).collect()
    rows = {(r.doc_id, r.text or "") for r in odd.collect()}
    assert len(got) == odd.count()
    want = {(i, hashlib.sha256(e.encode()).hexdigest()) for i, _, e, _ in edited(rows)}
    ids = [i for i, _ in rows]
    for r in got:      # equal ids are ordered by hash, which Python does not see here
        if ids.count(r.doc_id) == 1 and ids.count((r.doc_id or 0) + 1) == 1 and r.doc_id is not None:
            assert (r.doc_id, r.edited_sha256) in want


def test_one_document_and_none(spark, empty):
    one = P.compare(spark.createDataFrame([(3, "abcd efgh ijkl")], "doc_id long, text string")).first()
    assert (one.near_next, one.edited_sha256) == (1.0, hashlib.sha256(b"abcd efgh iabc").hexdigest())
    assert P.compare(empty).count() == 0


def test_runs_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert not re.search("Python|Pandas|Arrow", P.compare(docs)._jdf.queryExecution().executedPlan().toString())
