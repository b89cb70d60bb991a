"""From raw documents to token ids: toxic texts go, one of each near-duplicate
group stays, personal data is generalised, sources are mixed to their target
weights, and what is left is encoded.

Each stage reads all its predecessor kept, as Parquet in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from delayrisk.llm import bpe, mixing, pii, simhash_ball, toxicity
from delayrisk.llm.common import stage, table
from delayrisk.llm.queries import VOCABULARY, held_out

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REJECT = 0.3  # toxicity scores from here on are rejected, as op7 predicts


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below ``REJECT``; the model learns from the training fold's labels."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train=~held_out())
    scored = toxicity.score(docs, model, out="toxicity")
    return scored.filter(scored[scored.columns[-1]] < REJECT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: 3-word shingles, fingerprints linked at 2 or fewer bits."""
    return simhash_ball.keep_one(docs, size=3, seed=42, radius=2)


def generalise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Addresses and numbers become their kind, and terms that give them away go."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's repetition rate says."""
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and ids of every copy in the mix."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(VOCABULARY))


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("pii", generalise_personal_data),
          ("mix_sources", mix_sources), ("bpe", encode)]

#: Language models, fingerprints and BPE are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
