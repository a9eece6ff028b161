"""The jobs as registered queries: each runs twice over a whole table into one new folder, and what then stands there is the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlens.plans import bridge
from readlens.plans.queries import PLACED_BASES
from readlens.session import shared_folder

from . import overlap_calibration, quality_monitor


def _folder(spark: SparkSession, job: str) -> str:
    return f"{shared_folder(spark)}/jobs/{job}-{uuid.uuid4().hex}"


def _beside(rows: DataFrame, each: DataFrame) -> DataFrame:
    """All of each, a row of every source, with the rows of that source; null is a source."""
    rows = rows.withColumnRenamed("source", "own")
    return each.join(rows, F.col("source").eqNullSafe(F.col("own")), "left").drop("own")


def job1_overlap_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "overlap_calibration")
    for _ in range(2):
        found = overlap_calibration.run(spark, f"{sf_dir}/documents.parquet", out)
    both = _beside(found["calibration"], found["pairs"])
    return both.withColumns({c: F.round(c, 6) for c in ("errors", "empirical_q")})


def job2_quality_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "quality_monitor")
    table = f"{sf_dir}/[d]ocuments.parquet"  # a pattern of one path: file streams take patterns and folders, and this may be a file
    for _ in range(2):
        found = quality_monitor.run(spark, table, f"{out}/tables", f"{out}/checkpoint")
    both = _beside(found["profile"], found["summary"])
    return both.withColumns({c: F.round(c, 6) for c in ("mean_q", "claimed_rate", "lag_correlation")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "job1_overlap_calibration": job1_overlap_calibration,
    "job2_quality_monitor": job2_quality_monitor,
}

ORACLE_SQL: dict[str, str] = {
    "job1_overlap_calibration": bridge.SQL + PLACED_BASES + """, src AS (SELECT read_id AS pair_id, nullif(source, '') AS source FROM reads),
ps AS (SELECT source, count(*) AS pairs, count(*) FILTER (status = 'no_overlap') AS no_overlap, count(*) FILTER (status = 'indel') AS indel,
  CAST(coalesce(sum(overlap - mismatches) FILTER (status = 'placed'), 0) AS BIGINT) AS agree, CAST(coalesce(sum(mismatches) FILTER (status = 'placed'), 0) AS BIGINT) AS disagree FROM pd JOIN src USING (pair_id) GROUP BY source),
ce AS (SELECT source, q1[p1 + 1] AS q_1, q2[m - (p1 - o)] AS q_2, count(*) AS n, count(*) FILTER (substr(a, p1 + 1, 1) <> substr(b, p1 - o + 1, 1)) AS differ FROM ov JOIN src USING (pair_id) GROUP BY ALL),
sd AS (SELECT source, 1 AS mate, q_1 AS q, n, differ * pow(10, -q_1 / 10) / (pow(10, -q_1 / 10) + pow(10, -q_2 / 10)) AS e FROM ce
  UNION ALL SELECT source, 2, q_2, n, differ * pow(10, -q_2 / 10) / (pow(10, -q_1 / 10) + pow(10, -q_2 / 10)) FROM ce),
ca AS (SELECT source AS own, mate, q, CAST(sum(n) AS BIGINT) AS bases, round(sum(e), 6) AS errors, round(-10 * log10((sum(e) + 0.5) / (sum(n) + 1)), 6) AS empirical_q FROM sd GROUP BY source, mate, q)
SELECT ps.*, ca.* EXCLUDE (own) FROM ps LEFT JOIN ca ON ca.own IS NOT DISTINCT FROM ps.source""",
    "job2_quality_monitor": bridge.SQL + """, w AS (SELECT nullif(source, '') AS source, q, pos_start, lag(q) OVER (PARTITION BY read_id ORDER BY pos_start) AS q_m1, substr('.' || seq || '.', pos_start, 3) AS context FROM bases),
pf AS (SELECT source AS own, 'position' AS axis, CAST(pos_start AS VARCHAR) AS value, q, count(*) AS n FROM w GROUP BY ALL
  UNION ALL SELECT source, 'transition', CAST(q_m1 AS VARCHAR), q, count(*) FROM w WHERE q_m1 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT source, 'context', context, q, count(*) FROM w GROUP BY ALL),
sm AS (SELECT source, count(*) AS bases, round(avg(q), 6) AS mean_q, round(avg(pow(10, -q / 10)), 6) AS claimed_rate, round(corr(q_m1, q), 6) AS lag_correlation FROM w GROUP BY source)
SELECT sm.*, axis, value, q, n FROM sm LEFT JOIN pf ON pf.own IS NOT DISTINCT FROM sm.source""",
}
