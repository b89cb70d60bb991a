"""One registered query per operator, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, fingerprints, mixing, pii, prefix_forest, set_join, simhash_ball, source_audit, suffix_dedup,
               token_files, toxicity, vantage_kmeans, warc)
from .common import stage, table

VOCABULARY = "byte_bpe_50k.json"


def held_out(id_col: str = "doc_id"):
    """Rows that give no labels: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_warc_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "offset")


def op3_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))
    every = F.array_sort(F.concat("base", "terms"))
    return found.select(F.col("i").alias("doc_id"), *[pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.PATTERNS],
                        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(every).alias("spans"))


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op5_mix_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY))


def op7_toxicity_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train=~held_out())
    return toxicity.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_ball.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = stage(fingerprints.compare(table(spark, sf_dir, "documents")), "compared")
    bits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0")).alias(c)
    return fingerprints.search(compared).select(
        "doc_id", "n_chars", "edited_sha256", bits("fingerprint"), bits("edited_fingerprint"), "near_edited", "near_next",
        "n_near")


def op10_sparse_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op11_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.classes_of(table(spark, sf_dir, "documents"), size=3, percent=90)


def op12_vantage_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = vantage_kmeans.cluster(table(spark, sf_dir, "embeddings"))
    return vantage_kmeans.with_inertia(stage(found, "clusters"), centroids).select(
        F.col("i").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_hash_prefix_forest, op2_warc_history, op3_pii_disclosure, op4_token_orc, op5_mix_weights, op6_bpe_transducer,
                                   op7_toxicity_kneser_ney, op8_simhash_ball, op9_fingerprints,
                                   op10_sparse_suffix_array, op11_set_relation_join, op12_vantage_kmeans,
                                   op13_source_audit)}

def _kmeans_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds written out: distances of all vectors to all centroids."""
    nearest = """
a{n} AS MATERIALIZED (SELECT vec_id, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM
  (SELECT e.vec_id, s.c, sum((e.v - s.v) * (e.v - s.v))::BIGINT AS d FROM e JOIN c{n} s USING (dim) GROUP BY ALL) GROUP BY vec_id)"""
    move = """
c{m} AS MATERIALIZED (SELECT s.c, s.dim, coalesce(t.v, s.v) AS v FROM c{n} s LEFT JOIN
  (SELECT a.c, e.dim, ((sum(e.v) - ((sum(e.v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS v FROM a{n} a JOIN e USING (vec_id) GROUP BY a.c, e.dim) t
  ON s.c = t.c AND s.dim = t.dim)"""
    steps = ",".join(nearest.format(n=n) + "," + move.format(n=n, m=n + 1) for n in range(rounds))
    return f"""
WITH kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS dim, unnest(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) AS v FROM kept),
first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT first.c, e.dim, e.v FROM first JOIN e USING (vec_id)),{steps},{nearest.format(n=rounds)},
h AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
       sum(d) OVER ()::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN h USING (c)
"""


ORACLE = {
    "op5_mix_weights": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS h,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words,
             [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS weight
      FROM d GROUP BY source),
total AS (SELECT 1.5::DOUBLE * sum(words)::DOUBLE AS amount, sum(weight) AS w FROM s),
rounds AS (
  SELECT 0 AS n, -1::BIGINT AS was, 0::BIGINT AS full_n, amount AS level, w::DOUBLE AS unset FROM total
  UNION ALL
  SELECT r.n + 1, r.full_n,
    (SELECT count(*) FROM s WHERE r.unset > 0 AND weight * r.level / r.unset >= 2 * words),
    (SELECT amount FROM total) - (SELECT coalesce(sum(2 * words), 0) FROM s WHERE weight * r.level / r.unset >= 2 * words),
    (SELECT coalesce(sum(weight), 0) FROM s WHERE NOT weight * r.level / r.unset >= 2 * words)::DOUBLE
  FROM rounds r WHERE r.was <> r.full_n AND r.unset > 0),
fin AS (SELECT level, unset FROM rounds ORDER BY n DESC LIMIT 1),
t AS (SELECT source, words, CASE WHEN fin.unset = 0 OR weight * level / unset >= 2 * words THEN (2 * words)::DOUBLE
                                 ELSE weight * level / unset END AS target,
      CASE WHEN source IS NULL THEN '5:null' ELSE '5:=' || source END AS k FROM s, fin),
r AS (SELECT *, CASE WHEN words > 0 THEN target / words ELSE 0.0 END AS rate,
             ('0x' || substr(md5(k), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS start FROM t),
p AS (SELECT d.doc_id, d.size, r.words, r.target, r.rate, r.rate - floor(r.rate) AS part, r.start,
             (row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id, d.h) - 1)::DOUBLE AS pos
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, words AS source_size, target,
       size * (floor(rate) + (floor((pos + 1) * part + start) > floor(pos * part + start))::INT)::BIGINT AS taken FROM p
""",
    "op11_set_relation_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(len(w)::BIGINT - 2), lambda k: w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3]) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 190 * c >= 90 * (x.n + y.n)),
r AS (SELECT DISTINCT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.low, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a) m USING (doc_id)
""",
    "op12_vantage_kmeans": _kmeans_sql(),
    "op13_source_audit": r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS docs FROM w GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS total FROM c GROUP BY ALL HAVING sum(docs) >= 10),
l AS (SELECT lang, sum(total) AS big, count(*) AS v FROM k GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS big FROM g
       LEFT JOIN (SELECT c.* FROM c JOIN k USING (lang, term)) c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS MATERIALIZED (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n,
        (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (gn.big + 2 * l.v))::BIGINT AS p,
        (1 + 1000000000::HUGEINT * (k.total + 2) // (l.big + 2 * l.v))::BIGINT AS q
      FROM gn JOIN k USING (lang) JOIN l USING (lang)
      LEFT JOIN c ON c.lang = k.lang AND c.term = k.term AND c.source = gn.source),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value,
  (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM term) WHERE rank <= 10
""",
}
