"""Registered queries of the k-mer source: expected counts, predicted shares, tests of keys and places, raking, the whole fit.

Chances are fixed by a formula where SQL has to follow: a context of code c has an error at a rate of (1 + c mod 7) in a
thousand, of which category k has k of 45 parts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import kmer_source
from ..operators import bases as ba
from ..operators import kmers as km
from ..operators import loci
from ..operators import sketch as sk
from ..schema import BASES
from ..session import Stages
from ..table import CountTable, counted
from . import bridge
from .queries import _ROWS, K, V, C, _kvmer_rows, _rounded, _sketch, query

FLANK = (1, 1)
OPS = [f"{a}>{b}" for a in BASES for b in BASES if a != b] + [f"->{b}" for b in BASES] + [f"{b}>-" for b in BASES]
TOKENS = ["QualityWindow(0)", "Context(1,1)"]
ROUNDS = 2


def _fixed() -> np.ndarray:
    code = np.arange(5 ** (sum(FLANK) + 1))
    e = (1 + code % 7) / 1000
    p = e[:, None] * np.arange(10) / 45
    p[:, 0] = 1 - e
    centre = code // 5 % 5
    p[np.flatnonzero(centre < 4), 1 + centre[centre < 4]] = 0
    return p


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Stages(spark, "loci").write(_kvmer_rows(spark, sf_dir), "rows")


_CATEGORY = "CASE WHEN op LIKE '->%' THEN 4 + instr('ACGT', op[3]) WHEN op LIKE '%-' THEN 9 ELSE instr('ACGT', op[3]) END"
_FITS = "CASE WHEN op LIKE '->%' THEN e * cat / 45 WHEN centre = op[1] THEN e * cat / 45 / (1 - e) ELSE 0 END"
#: For each base of each locus its context, what is at risk and fails there; for each edit its odds at each base.
_PLACES = _ROWS + f""", lt AS (SELECT key, key || consensus AS locus, consensus_count + neighbor AS total FROM rw),
ps AS (SELECT rw.key, key || consensus AS locus, t, substr(consensus, t, 1) AS centre, substr(key || consensus || '.', {K} + t - 1, 3) AS context FROM rw, range(1, {V + 1}) r(t)),
pc AS (SELECT *, (1 + ((instr('ACGT.', context[1]) - 1) * 25 + (instr('ACGT.', context[2]) - 1) * 5 + instr('ACGT.', context[3]) - 1) % 7) / 1000 AS e FROM ps),
rk AS (SELECT pc.*, coalesce(a.n, 0) AS risk, coalesce(a.n, 0) - coalesce(b.n, 0) AS failed FROM pc LEFT JOIN al a ON a.key = pc.key AND a.t = pc.t - 1 LEFT JOIN al b ON b.key = pc.key AND b.t = pc.t),
oc AS (SELECT *, {_CATEGORY} AS cat FROM lb), od AS (SELECT rk.*, op, cat, n, {_FITS} AS r FROM oc JOIN rk USING (key)),
nm AS (SELECT key, 1 + sum((10 - instr('ACGT', centre)) * e / 45 / (1 - e) + 26 * e / 45 + 9 * e / 45 / (1 - e)) AS every FROM pc GROUP BY key)"""


def _expected_sql(censored: str) -> str:
    """The expected counts with some places left out; the expression is one of columns of rk."""
    return f""", cs AS (SELECT *, {censored} AS gone FROM od), cr AS (SELECT *, {censored} AS gone FROM rk),
hl AS (SELECT key, op, any_value(n) AS n, sum(CASE WHEN gone THEN r ELSE 0 END) / sum(r) * any_value(n) AS held FROM cs GROUP BY key, op),
hk AS (SELECT key, sum(held) AS held FROM hl GROUP BY key), gn AS (SELECT key, sum(CASE WHEN gone THEN failed ELSE 0 END) AS gone FROM cr GROUP BY key),
kp AS (SELECT hl.key, op, n - least(hl.held * CASE WHEN hk.held > 0 THEN gn.gone / hk.held ELSE 0 END, n) AS kept FROM hl JOIN hk USING (key) JOIN gn USING (key)),
sh AS (SELECT cs.*, CASE WHEN gone THEN 0 ELSE coalesce(r / nullif(sum(CASE WHEN gone THEN 0 ELSE r END) OVER (PARTITION BY key, op), 0), 0) END * kept AS x FROM cs JOIN kp USING (key, op)),
mt AS (SELECT key, t, sum(x) AS x FROM sh WHERE op NOT LIKE '->%' GROUP BY key, t),
ec AS (SELECT context, op, x FROM sh UNION ALL SELECT context, '=', CASE WHEN gone THEN 0 ELSE risk END - coalesce(x, 0) FROM cr LEFT JOIN mt USING (key, t))
SELECT context, op, round(sum(x), 5) AS n FROM ec GROUP BY context, op HAVING round(sum(x), 5) > 0"""


@query(_PLACES + _expected_sql("false"))
def kmer_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One E-step over risk sets: counts by context of edits whose places are hidden."""
    at = loci.places(_rows(spark, sf_dir), K, V, FLANK, risk=True)
    return _rounded(loci.expected(at, loci.chances(spark, _fixed())).filter("op != ''"), "n", digits=5).filter("n > 0")


@query(_PLACES + _expected_sql("risk > 0 AND failed / risk > 0.5"))
def kmer_censored_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where bases at which most values fail are right-censored."""
    at = loci.places(_rows(spark, sf_dir), K, V, FLANK, risk=True)
    most = F.zip_with("failed", "exposure", lambda f, x: (x > 0) & (f > 0.5 * x))
    return _rounded(loci.expected(loci.censor(at, most), loci.chances(spark, _fixed())).filter("op != ''"), "n", digits=5).filter("n > 0")


@query(_PLACES + f""", op AS (SELECT unnest({OPS}) AS op), oa AS (SELECT *, {_CATEGORY} AS cat FROM op), ra AS (SELECT key, op, sum({_FITS}) AS r FROM oa, pc GROUP BY key, op)
SELECT locus, ra.op, CAST(total AS DOUBLE) AS total, CAST(coalesce(n, 0) AS DOUBLE) AS n, round(r / every, 8) AS share FROM ra JOIN lt USING (key) JOIN nm USING (key) LEFT JOIN lb ON lb.key = ra.key AND lb.op = ra.op""")
def kmer_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = loci.places(_rows(spark, sf_dir), K, V, FLANK)
    return _rounded(loci.predicted(at, loci.chances(spark, _fixed()), OPS), "share", digits=8)


_FACTOR = "n * ln(p1 / p0) + (d - n) * (ln(1 - p1) - ln(1 - p0))"
_TESTED = _PLACES + f""", os AS (SELECT key, op, any_value(n) AS n, sum(r) AS r FROM od GROUP BY key, op),
f0 AS (SELECT os.key, n, greatest(total, 1) AS d, least(greatest(r / every, 1e-9), 0.5) AS p0 FROM os JOIN nm USING (key) JOIN lt USING (key)), f1 AS (SELECT *, least(greatest(n / d, p0), 1 - 1e-9) AS p1 FROM f0),
fm AS (SELECT key, max({_FACTOR}) AS factor FROM f1 GROUP BY key), md AS (SELECT median(total) AS m FROM lt),
tk AS (SELECT rw.*, lt.locus, lt.total AS own, (rw.total - consensus_count - neighbor) / greatest(rw.total, 1) AS far, lt.total > 2 * m OR lt.total * 2 < m AS copies, m, 1 / (1 + exp(-(greatest(coalesce(factor, 0), 0) + ln(0.001 / 0.999)))) AS variant
  FROM rw JOIN lt USING (key) CROSS JOIN md LEFT JOIN fm USING (key)),
tm AS (SELECT *, far > 0.5 AS multi FROM tk)"""


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One turn of the test of keys. Texts have many far values, so that share is half here."""
    at = loci.coverage_flags(loci.places(_rows(spark, sf_dir), K, V, FLANK), far=0.5)
    return loci.test_keys(at, loci.chances(spark, _fixed()))


@query(_TESTED + " SELECT locus, CAST(own AS DOUBLE) AS total, round(far, 6) AS far, copies, multi, round(variant, 6) AS variant FROM tm")
def kmer_key_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_tested(spark, sf_dir).select("locus", "total", "far", "copies", "multi", "variant"), "far", "variant")


@query(_TESTED + """, v AS (SELECT *, variant >= 0.5 AND NOT copies AND NOT multi AS v, total - consensus_count - neighbor AS off FROM tm), w AS (SELECT *, v OR copies OR multi AS dropped FROM v)
SELECT count(*) AS keys, CAST(max(m) AS DOUBLE) AS median_coverage, count(*) FILTER (dropped) AS dropped, count(*) FILTER (copies) AS dropped_multi_copy, count(*) FILTER (multi) AS dropped_multi_locus, count(*) FILTER (v) AS dropped_variant, round(median(far), 6) AS far_median,
round(coalesce(sum(off) FILTER (multi), 0) / greatest(sum(off), 1e-12), 6) AS far_values_dropped, count(*) FILTER (NOT passes) AS filter_dropped, count(*) FILTER (dropped AND NOT passes) AS both_dropped,
round((coalesce(sum(neighbor) FILTER (NOT dropped), 0) / greatest(coalesce(sum(own) FILTER (NOT dropped), 0), 1)) / greatest(coalesce(sum(neighbor) FILTER (passes), 0) / greatest(coalesce(sum(own) FILTER (passes), 0), 1), 1e-12), 6) AS level FROM w""")
def kmer_key_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(loci.key_report(_tested(spark, sf_dir)), "far_median", "far_values_dropped", "level")


@query(_PLACES + f""", ft AS (SELECT rk.locus, t, e, risk, CASE WHEN t < {V} THEN failed ELSE greatest(coalesce((SELECT n FROM al WHERE al.key = rk.key AND al.t = {V}), 0) - consensus_count, 0) END AS n, (total - consensus_count - neighbor) / greatest(total, 1) > 0.5 AS multi FROM rk JOIN rw USING (key)),
f0 AS (SELECT *, greatest(risk, 1) AS d, least(greatest(e, 1e-9), 0.5) AS p0 FROM ft WHERE NOT multi), f1 AS (SELECT *, least(greatest(n / d, p0), 1 - 1e-9) AS p1 FROM f0), f2 AS (SELECT *, 1 / (1 + exp(-({_FACTOR} + ln(0.001 / 0.999)))) AS chance FROM f1)
SELECT locus, CAST(t AS INTEGER) AS t, round(chance, 6) AS chance FROM f2 WHERE chance >= 0.5""")
def kmer_polymorphic_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = loci.places(_rows(spark, sf_dir), K, V, FLANK, risk=True).withColumn("multi", loci.far_fraction() > 0.5)
    found = loci.test_places(at, loci.chances(spark, _fixed()))
    each = found.select("locus", F.posexplode("polymorphic").alias("t", "chance")).filter("chance >= 0.5")
    return _rounded(each.withColumn("t", F.col("t") + 1), "chance")


def _raked_sql() -> str:
    """Raking to two margins, so many rounds: x0 starts from the margins' product, a round scales to qualities, then to contexts."""
    parts = [""", cx AS (SELECT substr('.' || seq || '.', pos_start, 3) AS context, q, count(*) AS n FROM bases GROUP BY ALL),
cf AS (SELECT *, (1 + ((instr('ACGT.', context[1]) - 1) * 25 + (instr('ACGT.', context[2]) - 1) * 5 + instr('ACGT.', context[3]) - 1) % 7) / 1000 AS e0, pow(10, -q / 10) / 2 + 0.0001 AS rate FROM cx),
ce AS (SELECT * FROM cf),
mq AS (SELECT q, sum(n) * any_value(rate) AS want, sum(n) AS n FROM cf GROUP BY q), lv AS (SELECT sum(want) AS level FROM mq),
mc AS (SELECT context, sum(n) * any_value(e0) * (SELECT level FROM lv) / (SELECT sum(n * e0) FROM cf) AS want, sum(n) AS n FROM cf GROUP BY context),
s0 AS (SELECT ce.context, ce.q, ce.n, e0, ce.n * (mq.want / mq.n) * (mc.want / mc.n) AS x FROM ce JOIN mq USING (q) JOIN mc USING (context)),
x0 AS (SELECT * REPLACE (x * (SELECT level FROM lv) / (SELECT sum(x) FROM s0) AS x) FROM s0)"""]  # fmt: skip
    for i in range(ROUNDS):
        parts.append(f"""y{i} AS (SELECT x.* REPLACE (x.x * want / sum(x.x) OVER (PARTITION BY x.q) AS x) FROM x{i} x JOIN mq USING (q)),
x{i + 1} AS (SELECT y.* REPLACE (y.x * want / sum(y.x) OVER (PARTITION BY y.context) AS x) FROM y{i} y JOIN mc USING (context))""")
    return ", ".join(parts) + f""", r AS (SELECT context, q, n, e0, least(x, n) AS x FROM x{ROUNDS}), k AS (SELECT unnest(range(1, 10)) AS cat),
lab AS (SELECT context, q, '=' AS op, n - x AS n FROM r UNION ALL
  SELECT context, q, CASE WHEN cat < 5 THEN context[2] || '>' || 'ACGT'[cat] WHEN cat < 9 THEN '->' || 'ACGT'[cat - 4] ELSE context[2] || '>-' END, x * cat / 45 FROM r, k WHERE cat > 4 OR 'ACGT'[cat] <> context[2])
SELECT context, q, op, round(n, 6) AS n FROM lab WHERE n > 0"""


@query(_raked_sql())
def kmer_raked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads' bases by context and quality with errors raked to rates by either, a fixed number of rounds."""
    exposure = CountTable(ba.base_counts(bridge.reads(spark, sf_dir), ["context", "q"], FLANK), ("context", "q"))
    rates = spark.createDataFrame([(q, 10 ** (-q / 10) / 2 + 0.0001) for q in bridge.QUALITIES], "q int, rate double")
    return _rounded(kmer_source.raked(_fixed(), FLANK, rates, exposure, ROUNDS), "n")


def _source(spark: SparkSession, sf_dir: str) -> kmer_source.Sketch:
    """The bridge's reads and their sketch as one source. Strands and GC bins are those of planted errors."""
    stages = Stages(spark, "source")
    reads = bridge.reads(spark, sf_dir)
    counts, best = _sketch(spark, sf_dir)
    best = stages.write(best, "best")
    rows = stages.write(sk.kvmer_rows(counts, best, V), "rows")
    scanned = stages.write(sk.scan_rates(reads.select("read_id", "seq", "q"), best, K, V, C), "scanned")
    hazard = stages.write(km.hazard(km.survival(counts, best, V)), "hazard")
    rate = km.weibull(hazard).first()["h1"] or 0.01
    rates = scanned.filter("axis = 'q'").select(F.col("value").alias("q"), (F.col("num_error") / (F.col("num_error") + F.col("num_correct"))).alias("rate"))
    positions = scanned.filter("axis != 'q'").select(F.col("value").alias("index"), (F.col("axis") == "pos_start").alias("from_start"), "num_correct", "num_error")
    # Bases and lengths are counted once; the fit reads these tables several times.
    fields = ("q_m1", "pos_start", "pos_end", "mate", "context", "q")
    qualities = CountTable(stages.write(ba.base_counts(reads, list(fields), FLANK), "qualities"), fields)
    exposure = CountTable(stages.write(counted(qualities.df, ["context", "q"], "n"), "exposure"), ("context", "q"))
    lengths = stages.write(counted(reads.select(F.length("seq").alias("length")), ["length"]), "lengths")
    none = lambda schema: spark.createDataFrame([], schema)
    return kmer_source.Sketch(
        K, V, rows, rates, positions, none("op string, forward long, total long"), none("lo int, hi int, rate double, num_error long"), hazard, rate,
        exposure, lengths, qualities,
    )


@query()
def kmer_source_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(component, array, slot, category, weight): the error head of the whole fit, curves by position included."""
    spec = kmer_source.fit(_source(spark, sf_dir), [*TOKENS, "Position(4)"], ["QualityMarkov(1)", "Mate", "Context(1,1)"])
    rows = []
    for c in spec.error:
        for name, x in sorted(c.arrays.items()):
            flat = x.reshape(len(x), -1)
            rows += [(c.token, name, i, j, float(flat[i, j])) for i in range(flat.shape[0]) for j in range(flat.shape[1])]
    return spark.createDataFrame(rows, "component string, array string, slot int, category int, weight double")
