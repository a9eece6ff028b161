"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontam, exponion, langid, maxent, media, neardup, pii, tokencount, toxicity, urlfilter

MEDIA_WIDTH = 192
TOKEN_LIMIT = 512
SIMILARITY = 0.8
NEAREST = 20
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(id_: Column, folds: int, fold: int) -> Column:
    """Whether a row is of the fold that its id's checksum gives."""
    return F.crc32(id_.cast("string")) % folds == fold


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), SIMILARITY)


def op4_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(_read(spark, sf_dir, "documents"), MEDIA_WIDTH)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"), _fold(F.col("doc_id"), 4, 2))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), TOKEN_LIMIT)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(_read(spark, sf_dir, "documents"), _fold(F.col("doc_id"), 10, 0))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_read(spark, sf_dir, "documents"), SIMILARITY)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return urlfilter.judge(_read(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


def toxic_fold(id_: Column) -> Column:
    return _fold(id_, 5, 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), toxic_fold)


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, NEAREST)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.cluster(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_decontamination": op3_decontamination,
    "op4_media_png": op4_media_png,
    "op5_language_id": op5_language_id,
    "op6_token_counts": op6_token_counts,
    "op7_lm_score": op7_lm_score,
    "op8_near_dup": op8_near_dup,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_nearest": op11_nearest,
    "op12_clusters": op12_clusters,
}



def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """K-means as a chain of views: c0 has the first centroids, a0 the first assignment, c1 the centroids after it, and so on."""
    parts = ["""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""", f"""
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept ORDER BY sha256('3:' || vec_id), v LIMIT {k}
)"""]  # fmt: skip
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(kept.v) AS v,
         min({{'d': CAST(list_sum(list_transform(list_zip(kept.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'c': c.c}}) AS near
  FROM kept, c{i} c GROUP BY r
)""")
        if i < rounds:
            parts.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.v, c.v) AS v
  FROM c{i} c LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS v
    FROM (SELECT near.c AS c, place, sum(v[place]) AS s, count(*) AS n FROM a{i}, range(1, 65) p(place) GROUP BY ALL) GROUP BY c
  ) m USING (c)
)""")
    return "WITH " + ",".join(parts) + f"""
SELECT vec_id, CAST(near.c AS INTEGER) AS cluster, near.d AS distance, CAST(sum(near.d) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(near.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.near.c
"""


ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents
), b AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), bs AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)
), size AS (
  SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id
), hit AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY ALL
)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM hit JOIN size USING (item_id) WHERE n_shared >= 0.8 * n_item
""",
    "op9_url_filter": """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rhost, rpath, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM split, rules
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM split s LEFT JOIN fits f USING (page_id)
""",
    "op12_clusters": _clusters_sql(),
}
