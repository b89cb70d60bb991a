import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from delayrisk.llm import source_audit as A

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=10, top=10):
    """rows: (text, lang, source), nulls allowed."""
    rows = [tuple(x or "" for x in r) for r in rows]
    n, docs, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(LOWER))
        groups[lang].add(source)
        n.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for (k, t), c in docs.items() if k == lang and c >= least]
        v = len(kept)
        every = {t: sum(n[lang, s, t] for s in sources) for t in kept}
        big = {s: sum(n[lang, s, t] for t in kept) for s in sources}
        p = {(s, t): 1 + 10**9 * (n[lang, s, t] + 2) // (big[s] + 2 * v) for s in sources for t in kept}
        q = {t: 1 + 10**9 * (every[t] + 2) // (sum(every.values()) + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = sorted((-sum(f(p[s, t], p[o, t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out |= {(lang, s, "pair", o, -x, r) for r, (x, _, o) in enumerate(pair, 1)}
            term = sorted((-f(p[s, t], q[t]), t.encode(), t) for t in kept if n[lang, s, t] and p[s, t] > q[t])
            out |= {(lang, s, "term", t, -x, r) for r, (x, _, t) in enumerate(term[:top], 1)}
    return out


def check(docs, **args):
    got = [tuple(r) for r in A.audit(docs, **args).collect()]
    want = brute([(r.text, r.lang, r.source) for r in docs.collect()], **args)
    assert len(got) == len(set(got)) and set(got) == want
    return want


def test_matches_brute_force(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


@pytest.mark.parametrize("least", [1, 2])
def test_odd_rows(odd, least):
    assert check(odd, least=least)


def test_empty_table_and_no_kept_terms(spark, empty):
    assert A.audit(empty).count() == 0
    few = check(spark.createDataFrame([("one two", "en", "a"), ("three", "en", "b"), (None, "en", None), ("x", "fr", "a")],
                                      "text string, lang string, source string"))
    assert {r[4] for r in few} == {0} and len(few) == 6


def test_small_slices_and_blocks_give_the_same(spark, monkeypatch):
    """A source with a third of all rows, more blocks than one, slices of one document."""
    rng = np.random.default_rng(1)
    words = ["a", "B", "ab", "abcdefgh", "abcdefghi", "abcdefghijklmnopq", "abcdefghijklmnopr", "é", "日本", "x\U0001f600y"]
    rows = [(" ".join(rng.choice(words, 30)) + "-" + "Z" * 5, "en", "hot" if k % 3 == 0 else f"s{k % 7}") for k in range(200)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    want = brute(rows, least=3)
    counts = A.term_counts(docs, size=1)
    monkeypatch.setattr(A, "CELLS", 24)
    kept, groups = A.kept_counts(counts, 3)
    got = A.ranked(A.pairs(kept, groups), "pair").unionByName(A.ranked(A.tops(kept), "term", 10))
    assert {tuple(r) for r in got.collect()} == want


def test_pointers_sort_as_their_terms():
    rng = np.random.default_rng(3)
    alphabet = [b"a", b"B", b"c", "é".encode(), "漢".encode()]
    texts = ["".join(x.decode() for x in rng.choice(np.array(alphabet, object), rng.integers(0, 40))) + " " * int(rng.integers(0, 2))
             for _ in range(400)] + ["", None, "a" * 70, "a" * 70 + "b", "a\x00b", "tail"]
    filled = pa.array([t or "" for t in texts]).slice(3)
    terms, g, n, docs = A.slice_counts(filled, np.arange(len(filled)) % 3)
    want, seen = Counter(), Counter()
    for k, t in enumerate(filled.to_pylist()):
        found = [x.encode() for x in TERM.findall(t.translate(LOWER))]
        want.update((x, k % 3) for x in found)
        seen.update({(x, k % 3) for x in found})
    assert dict(zip(zip(terms, g.tolist()), n.tolist())) == want
    assert dict(zip(zip(terms, g.tolist()), docs.tolist())) == seen
    assert list(zip(terms, g.tolist())) == sorted(zip(terms, g.tolist()))
