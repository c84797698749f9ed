"""The registered queries of the ten operators, thin digests of what the operators return, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import bayes_join, fm_quality, langid, lsm_dedup, mixing, nnpu_toxicity, pq_dedup, sp_wfst, token_counts, warc
from quadloom.llm.common import held_out, read


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fm_quality.fit_quality(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), fm_quality.quality_score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes_join.jaccard_join(read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    n = token_counts.token_count(spark, F.col("text"), tokenizer_path())
    out = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n.alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = nnpu_toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), nnpu_toxicity.toxicity_score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), langid.language(docs, langid.fit_languages(docs)).alias("l"))
    return found.select("doc_id", "held_out", "l.lang_pred", "l.score")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_dedup(read(spark, sf_dir, "embeddings"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_wfst.encode_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm_dedup.exact_dedup(read(spark, sf_dir, "documents"))


OP2_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
     f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN p.n >= 100 AND p.page_id <> f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.n >= 100 AND p.page_id <> f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""

OP3_SQL = r"""
WITH RECURSIVE
     w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w WHERE len(w) > 0),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE both_have >= CAST(0.8 AS DOUBLE) * (x.n + y.n - both_have) - CAST(1e-9 AS DOUBLE)),
     r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
     c AS (SELECT node, min(seen) AS class_id FROM r GROUP BY node)
SELECT d.doc_id, c.class_id, (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS n_links, d.doc_id = c.class_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null' || coalesce(text, ''))), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u,
                  CAST(1 AS DOUBLE) - CAST(0.9 AS DOUBLE) * len(regexp_extract_all(coalesce(text, ''), '[0-9!-/:-@\[-`{-~]')) / greatest(length(coalesce(text, '')), 1) AS w
           FROM documents),
     r AS (SELECT doc_id, source, size, CAST(1 AS DOUBLE) - pow(u, CAST(1 AS DOUBLE) / w) AS r FROM d),
     s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM r GROUP BY source),
     c AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / weight AS ratio, sum(source_size) OVER () AS total FROM s),
     l AS (SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                     / CAST(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM c),
     m AS (SELECT arg_min(level, ratio) AS level FROM l WHERE level * weight <= cap),
     t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(m.level * weight, CAST(cap AS DOUBLE))) AS target FROM l LEFT JOIN m ON true),
     e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
     o AS (SELECT r.doc_id, r.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
                  sum(r.size) OVER (PARTITION BY r.source ORDER BY r.r, r.doc_id, r.size ROWS UNBOUNDED PRECEDING) AS upto
           FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (epochs + CASE WHEN rest > 0 AND upto + upto - size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o
"""

OP8_SQL = """
WITH RECURSIVE
     v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
     u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
     l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= CAST(0.95 AS DOUBLE)),
     r AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
     c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.node = v.vec_id
"""

OP10_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.n AS group_size, coalesce(d.doc_id = g.keep_id, d.doc_id IS NULL AND g.keep_id IS NULL) AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_warc, op3_jaccard_join, op4_token_counts, op5_toxicity, op6_mixing, op7_language_id, op8_embedding_dedup, op9_sentencepiece, op10_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op3_jaccard_join": OP3_SQL, "op6_mixing": OP6_SQL, "op8_embedding_dedup": OP8_SQL, "op10_exact_dedup": OP10_SQL}
