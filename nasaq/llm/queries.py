"""Thin queries over the whole tables, one per operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language_id, near_dedup, pii, ppm, token_counts, token_store, topk, url_filter
from .frames import crc_bucket, pick


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(_documents(spark, sf_dir), "doc_id", "text", "lang").withColumn("held_out", crc_bucket("doc_id", 4) == 2)
    model = language_id.train(docs.where(~F.col("held_out")))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_documents(spark, sf_dir), crc_bucket("doc_id", 7) == 2)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate.find_items(pick(_documents(spark, sf_dir), "doc_id", "text"), items)
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("items"), "containment")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(_documents(spark, sf_dir), width=2, percent=80)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store(_documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_documents(spark, sf_dir))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = pick(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return topk.top_k(v, v.where("vec_id % 50 = 0"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_language_id, op3_lm_scoring, op4_decontamination, op5_token_counts, op6_near_dedup, op7_token_store, op8_pii, op9_url_filter, op10_topk)}

#: Words of the contract's kind: A-Z lower-cased, split at the six ASCII spaces.
_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_NEAR_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w
), x AS (
  SELECT doc_id, unnest(s) AS g FROM s
), n AS (
  SELECT doc_id, len(s) AS n FROM s
), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT i.a, i.b FROM i JOIN n na ON na.doc_id = i.a JOIN n nb ON nb.doc_id = i.b WHERE 100 * i.k >= 80 * (na.n + nb.n - i.k)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM n
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept
FROM n JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = n.doc_id
"""

_ITEMS_SQL = f"""
WITH i AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), s AS (
  SELECT item_id, least({decontaminate.WIDTH}, len(w)) AS k, unnest(list_distinct(list_transform(range(1, len(w) - least({decontaminate.WIDTH}, len(w)) + 2), lambda j: array_to_string(w[j : j + least({decontaminate.WIDTH}, len(w)) - 1], ' ')))) AS g FROM i WHERE len(w) > 0
), n AS (
  SELECT item_id, count(*) AS n FROM s GROUP BY item_id
), t AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), d AS (
  SELECT doc_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j : j + k - 1], ' ')))) AS g FROM t, (SELECT DISTINCT k FROM s)
), c AS (
  SELECT doc_id, item_id, count(*) / any_value(n.n) AS share FROM d JOIN s USING (k, g) JOIN n USING (item_id) GROUP BY doc_id, item_id
), f AS (
  SELECT doc_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items, max(share) AS containment FROM c WHERE share >= {decontaminate.THRESHOLD} - 1e-12 GROUP BY doc_id
)
SELECT doc_id, items IS NOT NULL AS contaminated, coalesce(items, '') AS items, coalesce(containment, 0.0)::DOUBLE AS containment FROM documents LEFT JOIN f USING (doc_id)
"""

ORACLE_SQL = {"op4_decontamination": _ITEMS_SQL, "op6_near_dedup": _NEAR_SQL, "op9_url_filter": url_filter.ORACLE_SQL, "op10_topk": topk.ORACLE_SQL}
