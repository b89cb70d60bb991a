import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from delayrisk.llm import mixing, toxicity
from delayrisk.llm.common import stage, table
from delayrisk.llm.queries import held_out, op7_toxicity_kneser_ney

from .test_simhash_ball import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, in order, documents first."""
    docs = table(spark, SF, "documents")
    out = [docs]
    for name, step in C.STAGES:
        docs = stage(step(spark, docs, SF), name)
        out.append(docs)
    return out


def test_columns(stages):
    assert all(tuple(s.columns) == C.COLUMNS for s in stages[:-1])
    assert len(C.STAGES) == 5 and [n for n, _ in C.STAGES][0] == "toxicity"


def test_toxicity_stage(spark, stages):
    model = toxicity.fit(stages[0], table(spark, SF, "labels"), train=~held_out())
    want = {r.doc_id for r in stages[0].collect() if model.score(r.text) < C.REJECT}
    assert {r.doc_id for r in stages[1].collect()} == want
    assert stages[1].count() >= 0.8 * stages[0].count()


def test_planted_toxic_documents_go(spark):
    """The stage rejects what op7 calls toxic, most held-out documents labelled so among it."""
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    kept = {r.doc_id for r in C.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    called = {r.doc_id for r in op7_toxicity_kneser_ney(spark, sf).filter("predicted = 1").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()} - called
    toxic = {r.doc_id for r in table(spark, sf, "labels").filter(held_out() & (F.col("toxic") == 1)).collect()}
    assert len(toxic & called) >= 0.5 * len(toxic)


def test_dedup_stage(stages):
    texts = {r.doc_id: r.text for r in stages[1].collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    root = brute_components(set(prints.values()))
    low = {}
    for i, f in prints.items():
        low[root[f]] = min(i, low.get(root[f], i))
    assert {r.doc_id for r in stages[2].collect()} == set(low.values())


def test_personal_data_stage(stages):
    from .test_pii import brute
    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = {r.doc_id: r.text for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for i, t in before.items():
        assert (after[i] == t) == (not brute(t))
        assert not [s for s in brute(after[i]) if s[3] in {x[3] for x in brute(t)}]


def test_mixing_stage(stages):
    want = {r.doc_id: r.copies for r in mixing.mix(stages[3]).collect()}
    got = {r.doc_id: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}


def test_encoding_stage(stages):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    for r in rows[:60]:
        assert r.ids == t.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_run_is_the_stages(spark, stages):
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "ids").cast("decimal(38,0)"))).first()
    assert total(C.run(spark, SF)) == total(stages[5])


def test_odd_and_empty(spark, odd, empty):
    for docs in (odd.select(*C.COLUMNS), empty):
        for name, step in C.STAGES:
            docs = stage(step(spark, docs, SF), name)
        assert np.all([isinstance(r.ids, list) for r in docs.collect()])
