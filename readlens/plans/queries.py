"""The registered queries of the read-analytics operators, over the bridge's pseudo-reads, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gc_bin, gc_ten, op_class, parse_tile, revcomp
from ..operators import alignments as al
from ..operators import bases as ba
from ..operators import compare as cp
from ..operators import evidence as ev
from ..operators import kmers as km
from ..kernels import realign as ra
from ..models import rake
from ..models.heads import Head, Penalty
from ..operators import overlap as ov
from ..operators import sketch as sk
from ..report import exporters as ex
from ..streaming import counts as sc
from ..session import Stages
from ..table import CountTable, counted
from . import bridge

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with what follows the bridge's views in SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = bridge.SQL + sql
        return f

    return add


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of the bridge's alignments, planted substitutions being the truth; built-ins only, as nothing has a gap."""
    truth = ba.bases(bridge.reads(spark, sf_dir), before=1, after=1, flank=(1, 1), carry=("doc_id", "source", "chunk"))
    wrong = (F.col("pos_start") * 31 + F.col("read_id") * 17) % 23 == 0
    alt = F.translate("base", "ACGT", "CGTA")
    return truth.select("*", F.when(wrong, F.concat("base", F.lit(">"), alt)).otherwise("=").alias("op"), F.when(wrong, alt).otherwise(F.col("base")).alias("called"), F.lit("+").alias("strand"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with their contig and 0-based site."""
    return _observed(spark, sf_dir).withColumn("contig", F.col("source")).withColumn("site", (F.col("chunk") * bridge.WIDTH + F.col("pos_start") - 1).cast("long"))


def _observed_counts(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """`_placed` added up by some of its columns within the tasks; the rest of a base is never a row."""
    return ba.base_counts(bridge.placed(bridge.reads(spark, sf_dir)), list(fields), (1, 1))


def _table(rows: DataFrame, *fields: str) -> CountTable:
    return CountTable(counted(rows, list(fields)), fields, truth="op" in fields)


def _mates_apart(spark: SparkSession, sf_dir: str, *fields: str) -> tuple[CountTable, CountTable]:
    """Tables of the first and of the second mates, counted in one pass over the bases and written, as what follows reads them often."""
    rows = Stages(spark, "mates").write(counted(_observed(spark, sf_dir), ["mate", *fields]), "rows")
    a, b = (rows.filter(F.col("mate") == k).select(*fields, "n") for k in (1, 2))
    return CountTable(a, fields, truth="op" in fields), CountTable(b, fields, truth="op" in fields)


# Quality process ---------------------------------------------------------------------------------------------------


@query(""", lagged AS (SELECT lag(q) OVER (PARTITION BY read_id ORDER BY pos_start) AS q_m1, q FROM bases)
SELECT q_m1, q, count(*) AS n FROM lagged WHERE q_m1 IS NOT NULL GROUP BY q_m1, q""")
def quality_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ba.profile(bridge.reads(spark, sf_dir))["transition"].df


@query(" SELECT pos_start, q, count(*) AS n FROM bases GROUP BY pos_start, q")
def quality_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ba.profile(bridge.reads(spark, sf_dir))["position"].df


@query(" SELECT substr('..' || seq || '..', pos_start, 5) AS context, q, count(*) AS n FROM bases GROUP BY 1, 2")
def quality_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ba.profile(bridge.reads(spark, sf_dir))["context"].df


@query(" SELECT CAST(length(seq) AS INTEGER) AS length, count(*) AS n FROM reads GROUP BY 1")
def read_length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ba.profile(bridge.reads(spark, sf_dir))["length"].df


@query(""", lagged AS (SELECT *, lag(q, 2) OVER w AS q_m2, lag(q) OVER w AS q_m1 FROM bases WINDOW w AS (PARTITION BY read_id ORDER BY pos_start))
SELECT q_m2, q_m1, pos_start, pos_end, mate, substr('.' || seq || '.', pos_start, 3) AS context, q, count(*) AS n FROM lagged GROUP BY ALL""")
def quality_rows_m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ba.quality_table(bridge.reads(spark, sf_dir), m=2, flank=(1, 1)).df


@query(""", lagged AS (SELECT CAST(lag(q) OVER (PARTITION BY read_id ORDER BY pos_start) AS DOUBLE) AS x, CAST(q AS DOUBLE) AS y FROM bases), p AS (SELECT * FROM lagged WHERE x IS NOT NULL)
SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy, round(corr(x, y), 6) AS r FROM p""")
def lag1_autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ba.lag_moments(ba.bases(bridge.reads(spark, sf_dir), before=1)), "r")


@query(" SELECT * FROM (SELECT read_id AS idx, seq FROM reads WHERE read_id >= 3 AND (read_id - 3) % 7 = 0 ORDER BY read_id LIMIT 500)")
def subset_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling operator: stride, offset and limit are the feature."""
    return ba.subset(bridge.reads(spark, sf_dir).select(F.col("read_id").alias("idx"), "seq"), 7, 3, 500)


@query(" SELECT CAST(10 * least(9, floor(10.0 * length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq))) AS INTEGER) AS gc, count(*) AS n FROM reads GROUP BY 1")
def gc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(bridge.reads(spark, sf_dir).select(gc_bin(F.col("seq")).alias("gc")), ["gc"])


@query(" SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM reads")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.reads(spark, sf_dir).select("read_id", revcomp(F.col("seq")).alias("rc"))


@query(""", named AS (SELECT read_id, CASE read_id % 3 WHEN 0 THEN 'm:1:f:' || chunk || ':' || doc_id || ':9:9 x' WHEN 1 THEN 'm:' || chunk || ':' || doc_id || ':9:9' ELSE 'm:a' END AS name FROM reads)
SELECT read_id, CASE read_id % 3 WHEN 0 THEN split_part(name, ':', 4) || '_' || split_part(name, ':', 5) WHEN 1 THEN split_part(name, ':', 2) || '_' || split_part(name, ':', 3) END AS tile FROM named""")
def tile_of_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.reads(spark, sf_dir)
    long = F.concat_ws(":", F.lit("m:1:f"), "chunk", "doc_id", F.lit("9:9 x"))
    short = F.concat_ws(":", F.lit("m"), "chunk", "doc_id", F.lit("9:9"))
    name = F.when(F.col("read_id") % 3 == 0, long).when(F.col("read_id") % 3 == 1, short).otherwise("m:a")
    return rows.select("read_id", parse_tile(name).alias("tile"))


@query(""", marked AS (SELECT read_id, pos_start, base, CASE WHEN base = lag(base) OVER (PARTITION BY read_id ORDER BY pos_start) THEN 0 ELSE 1 END AS new FROM bases),
runs AS (SELECT *, sum(new) OVER (PARTITION BY read_id ORDER BY pos_start) AS run_id FROM marked), each AS (SELECT read_id, run_id, base, count(*) AS run FROM runs GROUP BY ALL)
SELECT base, run, count(*) AS n FROM each GROUP BY base, run""")
def homopolymer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ba.read_runs(bridge.reads(spark, sf_dir)).withColumn("run", F.col("run").cast("long"))


# Count tables and evidence ---------------------------------------------------------------------------------------

_WINDOWED = """, w AS (SELECT *, lag(q) OVER v AS q_m1, lead(q) OVER v AS q_p1, substr('.' || seq || '.', pos_start, 3) AS context FROM obs WINDOW v AS (PARTITION BY read_id ORDER BY pos_start))"""


@query(_WINDOWED + " SELECT q, q_m1, q_p1, context, pos_start, pos_end, mate, '+' AS strand, op, count(*) AS n FROM w GROUP BY ALL")
def observation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(_observed(spark, sf_dir), "q", "q_m1", "q_p1", "context", "pos_start", "pos_end", "mate", "strand", "op").df


@query(" SELECT q, op, count(*) AS n FROM obs GROUP BY q, op")
def marginal_qop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(_observed(spark, sf_dir), "q", "mate", "op").marginal("q", "op").df


@query(" SELECT q, count(*) AS n, count(*) FILTER (op <> '=') AS errors FROM obs GROUP BY q")
def exposure_by_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(_observed(spark, sf_dir), "q", "op").exposure("q")


@query(" SELECT op, count(*) AS n FROM obs WHERE op = '=' OR op NOT LIKE '%-%' GROUP BY op")
def substitution_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(_observed(spark, sf_dir), "op").substitutions().df


@query(""", a AS (SELECT q, op, count(*) AS n FROM obs WHERE mate = 1 GROUP BY ALL), b AS (SELECT q, op, count(*) AS n FROM obs WHERE mate = 2 GROUP BY ALL)
SELECT q, op, a.n - coalesce(b.n, 0) AS n FROM a LEFT JOIN b USING (q, op) WHERE a.n > coalesce(b.n, 0)""")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _mates_apart(spark, sf_dir, "q", "op")
    return a.minus(b).df


@query(" SELECT q, op, count(*) AS n FROM obs GROUP BY ALL")
def table_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _mates_apart(spark, sf_dir, "q", "op")
    return a.plus(b).df


_MATES = """, a AS (SELECT q, pos_start, count(*) AS n, count(*) FILTER (op <> '=') AS e FROM obs WHERE mate = 1 GROUP BY ALL), b AS (SELECT q, pos_start, count(*) AS n, count(*) FILTER (op <> '=') AS e FROM obs WHERE mate = 2 GROUP BY ALL)"""


@query(_MATES + """, j AS (SELECT a.n AS n, b.n AS n_b, a.e AS e, b.e AS e_b FROM a JOIN b USING (q, pos_start) WHERE a.n >= 100 AND b.n >= 100),
s AS (SELECT count(*) AS shared, sum((n + n_b) * e / n) / sum(n + n_b) AS rate_a, sum((n + n_b) * e_b / n_b) / sum(n + n_b) AS rate_b, CAST(sum(n) AS BIGINT) AS n_a, CAST(sum(n_b) AS BIGINT) AS n_b FROM j)
SELECT shared, round(rate_a, 6) AS rate_a, round(rate_b, 6) AS rate_b, n_a, n_b, round(rate_b / rate_a, 6) AS ratio, round(rate_b - rate_a, 6) AS excess FROM s""")
def evidence_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _mates_apart(spark, sf_dir, "q", "pos_start", "op")
    return _rounded(ev.standardised(a, b, ["q", "pos_start"]), "rate_a", "rate_b", "ratio", "excess")


@query(""", a AS (SELECT q, op, count(*) AS n FROM obs WHERE mate = 1 GROUP BY ALL), sa AS (SELECT q, sum(n) AS n FROM a GROUP BY q),
sb AS (SELECT q, count(*) AS n FROM obs WHERE mate = 2 AND pos_start <= 50 GROUP BY q), r AS (SELECT sa.q, (sb.n / (SELECT sum(n) FROM sb)) / (sa.n / (SELECT sum(n) FROM sa)) AS f FROM sa JOIN sb USING (q))
SELECT q, op, round(n * f, 4) AS n FROM a JOIN r USING (q)""")
def on_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _mates_apart(spark, sf_dir, "q", "pos_start", "op")
    first = replace(b, df=b.df.filter("pos_start <= 50"))
    return _rounded(ev.on_support(a.marginal("q", "op"), first.marginal("q", "op"), ["q"]), "n", digits=4)


@query(""", c AS (SELECT *, substr('.' || seq || '.', pos_start, 3) AS context FROM obs WHERE op <> '='),
a AS (SELECT context, op, count(*) AS n FROM c WHERE mate = 1 GROUP BY ALL), b AS (SELECT context, op, count(*) AS n FROM c WHERE mate = 2 GROUP BY ALL),
j AS (SELECT coalesce(a.n, 0) / (SELECT sum(n) FROM a) AS x, coalesce(b.n, 0) / (SELECT sum(n) FROM b) AS y FROM a FULL JOIN b ON a.context = b.context AND a.op = b.op)
SELECT round(sum(abs(x - y)) / 2, 6) AS tv, round(corr(x, y), 6) AS r, count(*) AS rows FROM j""")
def spectrum_tv(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _mates_apart(spark, sf_dir, "context", "op")
    return _rounded(ev.spectrum_distance(a, b, ["context"]), "tv", "r")


@query(_MATES + " SELECT round(sum(a.n * abs(ln((b.e + 0.5) / (b.n + 1)) - ln((a.e + 0.5) / (a.n + 1)))) / sum(a.n), 6) AS distance, count(*) AS shared FROM a JOIN b USING (q, pos_start)")
def rate_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _mates_apart(spark, sf_dir, "q", "pos_start", "op")
    return _rounded(ev.rate_distance(a, b, ["q", "pos_start"]), "distance")


@query(""", c AS (SELECT CAST(q AS VARCHAR) AS q, CAST((pos_start - 1) // 10 AS VARCHAR) AS cycle, substr('.' || seq || '.', pos_start, 3) AS context, CASE WHEN op = '=' THEN 'match' ELSE 'sub' END AS class FROM obs)
SELECT CASE WHEN q IS NOT NULL THEN 'q' WHEN cycle IS NOT NULL THEN 'cycle' ELSE 'context' END AS axis, coalesce(q, cycle, context) AS value, class, count(*) AS n FROM c GROUP BY GROUPING SETS ((q, class), (cycle, class), (context, class))""")
def error_rows_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.error_axes(_table(_observed(spark, sf_dir), "q", "pos_start", "context", "op").df)


_RATES = """, r AS (SELECT read_id, count(*) FILTER (op <> '=') AS e, count(*) AS n FROM obs GROUP BY read_id), h AS (SELECT CAST(least(50, floor(e / n / 0.002)) AS INTEGER) AS bin, count(*) AS reads FROM r GROUP BY 1)"""


@query(_RATES + " SELECT bin, reads FROM h")
def read_rate_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.read_rates(_observed(spark, sf_dir).withColumn("n", F.lit(1)))


@query(_RATES + """, c AS (SELECT bin, sum(reads) OVER (ORDER BY bin) / (SELECT sum(reads) FROM h) AS share FROM h)
SELECT s.share, round(CAST((min(c.bin) + 0.5) * 0.002 AS DOUBLE), 6) AS value FROM c JOIN (VALUES (CAST(0.1 AS DOUBLE)), (0.5), (0.9)) s(share) ON c.share >= s.share GROUP BY s.share""")
def read_rate_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.quantiles(ev.read_rates(_observed(spark, sf_dir).withColumn("n", F.lit(1))), [0.1, 0.5, 0.9]), "value")


@query(" SELECT round(avg(pow(10.0, -q / 10.0)), 6) AS implied, round(count(*) FILTER (op <> '=') / count(*), 6) AS measured FROM obs")
def implied_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.implied_rate(_table(_observed(spark, sf_dir), "q", "op").df), "implied", "measured")


@query(" SELECT CASE WHEN op = '=' THEN 'match' ELSE 'sub' END AS class, base, count(*) AS n FROM obs GROUP BY ALL")
def op_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(_observed(spark, sf_dir).select(op_class(F.col("op")).alias("class"), "base"), ["class", "base"])


# k-mers -----------------------------------------------------------------------------------------------------------

_KMERS = """, kw AS (SELECT substr(seq, i, 21) AS w FROM (SELECT seq, unnest(range(1, length(seq) - 19)) AS i FROM reads WHERE length(seq) >= 21)),
kc AS (SELECT least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM kw GROUP BY 1)"""
_KNOWN = f""", braw AS (SELECT regexp_replace(translate(text, '{bridge._LETTERS}', '{bridge._BASES}'), '[^ACGT]', '', 'g') AS s FROM benchmark),
bw AS (SELECT substr(s, i, 21) AS w FROM (SELECT s, unnest(range(1, length(s) - 19)) AS i FROM braw WHERE length(s) >= 21)), known AS (SELECT DISTINCT least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer FROM bw)"""


@query(_KMERS + " SELECT kmer, n FROM kc")
def kmer_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.kmers(bridge.reads(spark, sf_dir), 21)


@query(_KMERS + " SELECT least(n, 50) AS multiplicity, count(*) AS kmers FROM kc GROUP BY 1")
def kmer_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.spectrum(km.kmers(bridge.reads(spark, sf_dir), 21))


@query(_KMERS + _KNOWN + " SELECT count(*) AS kmers, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / (SELECT sum(n) FROM kc), 6) AS share FROM kc WHERE kmer NOT IN (SELECT kmer FROM known)")
def kmer_absent_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = km.kmers(bridge.reads(spark, sf_dir), 21)
    texts = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.regexp_replace(F.translate("text", bridge._LETTERS, bridge._BASES), "[^ACGT]", "").alias("seq"))
    # The benchmark's k-mers are marked among all counts, which so are made once.
    flagged = counts.join(km.kmers(texts, 21).select("kmer", F.lit(1).alias("known")), "kmer", "left")
    lost = F.when(F.col("known").isNull(), F.col("n")).otherwise(0)
    return _rounded(flagged.agg(F.count(F.when(F.col("known").isNull(), 1)).alias("kmers"), F.sum(lost).alias("n"), (F.sum(lost) / F.sum("n")).alias("share")), "share")


K, V, C = 11, 13, 8
_PAIRS = f""", strands AS (SELECT seq FROM reads WHERE length(seq) >= {K + V} UNION ALL SELECT reverse(translate(seq, 'ACGT', 'TGCA')) FROM reads WHERE length(seq) >= {K + V}),
pw AS (SELECT substr(seq, i, {K}) AS key, substr(seq, i + {K}, {V}) AS value FROM (SELECT seq, unnest(range(1, length(seq) - {K + V - 2})) AS i FROM strands)),
kv AS (SELECT key, value, count(*) AS n FROM pw WHERE md5(key) < '{(1 << 128) // C:032x}' GROUP BY ALL),
best AS (SELECT key, arg_min(value, (-n, value)) AS consensus, max(n) AS consensus_count, CAST(sum(n) AS BIGINT) AS total FROM kv GROUP BY key HAVING sum(n) >= 10),
ts AS (SELECT unnest(range(0, {V + 1})) AS t), alive AS (SELECT t, CAST(sum(n) AS BIGINT) AS survived FROM kv JOIN best USING (key) JOIN ts ON substr(value, 1, t) = substr(consensus, 1, t) GROUP BY t),
hz AS (SELECT a.t, b.survived AS at_risk, a.survived, 1 - a.survived / b.survived AS hazard FROM alive a JOIN alive b ON b.t = a.t - 1),
near AS (SELECT key, value, consensus, n FROM kv JOIN best USING (key) WHERE value <> consensus AND list_bool_or([
  substr(value, 1, i) = substr(consensus, 1, i) AND (substr(value, i + 2) = substr(consensus, i + 2) OR substr(value, i + 2, {V} - i - 1) = substr(consensus, i + 1, {V} - i - 1) OR substr(value, i + 1, {V} - i - 1) = substr(consensus, i + 2, {V} - i - 1))
  FOR i IN range(0, {V})]))"""


def _sketch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Counts and consensus; the counts are written, as all that follows reads them more than once."""
    counts = Stages(spark, "sketch").write(km.pairs(bridge.reads(spark, sf_dir), K, V, c=C), "counts")
    return counts, km.consensus(counts)


@query(_PAIRS + " SELECT key, consensus, consensus_count, total FROM best")
def kvmer_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sketch(spark, sf_dir)[1]


@query(_PAIRS + " SELECT CAST(t AS INTEGER) AS t, survived FROM alive")
def kvmer_nkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.survival(*_sketch(spark, sf_dir), V).groupBy("t").agg(F.sum("n").alias("survived"))


@query(_PAIRS + " SELECT CAST(t AS INTEGER) AS t, at_risk, survived, round(hazard, 6) AS hazard FROM hz")
def kvmer_hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(km.hazard(km.survival(*_sketch(spark, sf_dir), V)), "hazard")


@query(_PAIRS + """, ok AS (SELECT ln(t) AS x, ln(-ln(1 - hazard)) AS y FROM hz WHERE hazard > 0 AND hazard < 1), f AS (SELECT regr_slope(y, x) + 1 AS beta, exp(regr_intercept(y, x)) AS e, count(*) AS points FROM ok)
SELECT round(beta, 5) AS beta, round(e / beta, 5) AS "lambda", round(1 - exp(-e / beta), 5) AS h1, points FROM f""")
def weibull_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(km.weibull(km.hazard(km.survival(*_sketch(spark, sf_dir), V))), "beta", "lambda", "h1", digits=5)


@query(_PAIRS + " SELECT key, value, n FROM near")
def one_edit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.neighbours(*_sketch(spark, sf_dir), V).select("key", "value", "n")


@query(_PAIRS + f""", d AS (SELECT consensus, value, n, list_filter(range(1, {V + 1}), lambda i: substr(value, i, 1) <> substr(consensus, i, 1)) AS differ FROM near)
SELECT substr(consensus, differ[1], 1) || '>' || substr(value, differ[1], 1) AS op, CAST(sum(n) AS BIGINT) AS n FROM d WHERE len(differ) = 1 GROUP BY 1""")
def op_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.substitutions(km.neighbours(*_sketch(spark, sf_dir), V), V)


@query(_PAIRS + f""", a AS (SELECT count(*) AS keys, CAST(sum(consensus_count) AS BIGINT) AS consensus_n, CAST(sum(total) AS BIGINT) AS total_n FROM best), b AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS neighbour_n FROM near)
SELECT keys, consensus_n, total_n, neighbour_n, round(neighbour_n / ({V} * (consensus_n + neighbour_n)), 8) AS level FROM a, b""")
def kvmer_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(km.levels(*_sketch(spark, sf_dir), V), "level", digits=8)


@query(_PAIRS + f""", rk AS (SELECT key, value, n, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS r, first_value(value) OVER (PARTITION BY key ORDER BY n DESC, value) AS major FROM kv),
e AS (SELECT *, r > 1 AND list_bool_or([substr(value, 1, i) = substr(major, 1, i) AND (substr(value, i + 2) = substr(major, i + 2) OR substr(value, i + 2, {V} - i - 1) = substr(major, i + 1, {V} - i - 1) OR substr(value, i + 1, {V} - i - 1) = substr(major, i + 2, {V} - i - 1)) FOR i IN range(0, {V})]) AS one FROM rk),
k AS (SELECT key, sum(n) AS n, count(*) AS v, sum(CASE WHEN r > 1 THEN n ELSE 0 END) AS off, sum(CASE WHEN one THEN n ELSE 0 END) AS near FROM e GROUP BY key)
SELECT round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS multi_locus, round(sum(CASE WHEN v > 1 THEN n ELSE 0 END) / sum(n), 6) AS multi_value, round(sum(off) / sum(n), 6) AS off_majority, round(sum(near) / sum(n), 6) AS one_edit, round(sum(off - near) / sum(n), 6) AS more_edits FROM k""")
def multiplicity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(km.multiplicity(_sketch(spark, sf_dir)[0], V), "multi_locus", "multi_value", "off_majority", "one_edit", "more_edits")


# What the sketch gives without a fit ------------------------------------------------------------------------------

_ROWS = _PAIRS + f""", pl AS (SELECT *, list_filter(range(1, {V + 1}), lambda i: substr(value, i, 1) <> substr(consensus, i, 1)) AS differ,
  list_filter(range(1, {V + 1}), lambda i: substr(value, 1, i - 1) = substr(consensus, 1, i - 1) AND substr(value, i, {V} - i) = substr(consensus, i + 1, {V} - i)) AS lost,
  list_filter(range(1, {V + 1}), lambda i: substr(value, 1, i - 1) = substr(consensus, 1, i - 1) AND substr(value, i + 1, {V} - i) = substr(consensus, i, {V} - i)) AS put FROM near),
lb AS (SELECT key, CASE WHEN len(differ) = 1 THEN substr(consensus, differ[1], 1) || '>' || substr(value, differ[1], 1) WHEN len(lost) > 0 THEN substr(consensus, lost[1], 1) || '>-' ELSE '->' || substr(value, put[1], 1) END AS op, CAST(sum(n) AS BIGINT) AS n FROM pl GROUP BY ALL),
nb AS (SELECT key, CAST(sum(n) AS BIGINT) AS neighbor FROM lb GROUP BY key),
rw AS (SELECT best.*, coalesce(neighbor, 0) AS neighbor, coalesce(neighbor, 0) <= consensus_count AS passes FROM best LEFT JOIN nb USING (key)),
al AS (SELECT key, t, CAST(sum(n) AS BIGINT) AS n FROM kv JOIN best USING (key) JOIN ts ON substr(value, 1, t) = substr(consensus, 1, t) GROUP BY ALL)"""


def _kvmer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sk.kvmer_rows(*_sketch(spark, sf_dir), V)


@query(_ROWS + " SELECT key || consensus AS locus, '=' AS op, consensus_count AS n FROM rw WHERE passes UNION ALL SELECT key || consensus, op, n FROM lb JOIN rw USING (key) WHERE passes")
def sketch_kvmer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sk.kvmer_table(_kvmer_rows(spark, sf_dir)).df


@query(_ROWS + " SELECT key || consensus AS locus, CAST(t AS INTEGER) AS t, '=' AS op, n FROM al JOIN rw USING (key)")
def sketch_survival_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sk.survival_table(_kvmer_rows(spark, sf_dir), use_all=True).df


@query(_ROWS + """ SELECT count(*) AS keys, count(*) FILTER (NOT passes) AS keys_dropped, count(DISTINCT consensus) AS consensus_values, count(DISTINCT consensus) - count(DISTINCT consensus) FILTER (passes) AS consensus_values_dropped,
CAST(sum(neighbor) AS BIGINT) AS error_mass, CAST(coalesce(sum(neighbor) FILTER (NOT passes), 0) AS BIGINT) AS error_mass_dropped, CAST(sum(total) AS BIGINT) AS observations, CAST(coalesce(sum(total) FILTER (NOT passes), 0) AS BIGINT) AS observations_dropped,
round(coalesce(sum(neighbor) FILTER (NOT passes), 0) / sum(neighbor), 8) AS error_mass_dropped_fraction FROM rw""")
def sketch_filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sk.filter_stats(_kvmer_rows(spark, sf_dir)), "error_mass_dropped_fraction", digits=8)


@query(_ROWS + f""", ex AS (SELECT rw.key, consensus_count + neighbor AS r, neighbor, (SELECT sum(least(n, consensus_count + neighbor)) FROM al WHERE al.key = rw.key AND t BETWEEN 1 AND {V - 1}) AS later FROM rw WHERE passes)
SELECT count(*) AS keys, CAST(sum(neighbor) AS BIGINT) AS single_edit_values, CAST(sum(r + coalesce(later, 0)) AS BIGINT) AS exposure, round(sum(neighbor) / sum(r + coalesce(later, 0)), 8) AS per_base_rate FROM ex""")
def sketch_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sk.kvmer_level(_kvmer_rows(spark, sf_dir)), "per_base_rate", digits=8)


@query(_PAIRS + " SELECT CAST(t AS INTEGER) AS t, round(hazard, 6) AS hazard FROM hz WHERE hazard > 0 AND hazard < 1")
def sketch_hazard_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sk.hazard_window(km.hazard(km.survival(*_sketch(spark, sf_dir), V)), "hazard"), "hazard")


_SCAN = _PAIRS + f""", st AS (SELECT read_id, seq, i, substr(seq, i, {K}) AS key FROM (SELECT read_id, seq, unnest(range(1, length(seq) - {K + V - 2})) AS i FROM reads WHERE length(seq) >= {K + V})),
fw AS (SELECT st.*, consensus FROM st JOIN best USING (key)), ft AS (SELECT read_id, length(seq) AS size, i, t, substr(seq, i + {K}, t) = substr(consensus, 1, t) AS ok, substr(seq, i + {K}, t - 1) = substr(consensus, 1, t - 1) AS reached FROM fw, ts WHERE t > 0),
sc AS (SELECT f.read_id, f.t, f.i + {K} + f.t - 1 AS pos, f.size - (f.i + {K} + f.t - 1) + 1 AS pos_end, b.q, f.ok FROM ft f JOIN bases b ON b.read_id = f.read_id AND b.pos_start = f.i + {K} + f.t - 1 WHERE reached)"""


def _scan_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sk.scan_rates(bridge.reads(spark, sf_dir), _sketch(spark, sf_dir)[1], K, V, C)


@query(_SCAN + f""" SELECT 'q' AS axis, q AS value, count(*) FILTER (ok) AS num_correct, count(*) FILTER (NOT ok) AS num_error FROM sc WHERE t BETWEEN 3 AND {V - 2} GROUP BY q
UNION ALL SELECT 'pos_start', CAST(pos AS INTEGER), count(*) FILTER (ok), count(*) FILTER (NOT ok) FROM sc GROUP BY pos UNION ALL SELECT 'pos_end', CAST(pos_end AS INTEGER), count(*) FILTER (ok), count(*) FILTER (NOT ok) FROM sc GROUP BY pos_end""")
def sketch_covariate_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan_rates(spark, sf_dir)


@query(_SCAN + " SELECT count(DISTINCT pos) AS cycles, round(count(*) FILTER (NOT ok) / count(*), 8) AS per_base_rate FROM sc")
def sketch_position_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _scan_rates(spark, sf_dir).filter("axis like 'pos%'").withColumn("from_start", F.col("axis") == "pos_start")
    return _rounded(sk.position_level(rates), "per_base_rate", digits=8)


@query(_PAIRS + f""", braw AS (SELECT regexp_replace(translate(text, '{bridge._LETTERS}', '{bridge._BASES}'), '[^ACGT]', '', 'g') AS s FROM benchmark), bs AS (SELECT s FROM braw WHERE length(s) >= {K + V} UNION ALL SELECT reverse(translate(s, 'ACGT', 'TGCA')) FROM braw WHERE length(s) >= {K + V}),
lo AS (SELECT substr(s, i, {K}) AS key, substr(s, i + {K}, {V}) AS value, count(*) AS n FROM (SELECT s, unnest(range(1, length(s) - {K + V - 2})) AS i FROM bs) GROUP BY ALL),
ln AS (SELECT key, sum(n) AS loci FROM lo GROUP BY key), jn AS (SELECT best.*, coalesce(loci, 0) AS loci, lo.value IS NOT NULL AS true_value FROM best LEFT JOIN ln USING (key) LEFT JOIN lo ON lo.key = best.key AND lo.value = best.consensus)
SELECT CASE WHEN loci >= 5 THEN '5+' WHEN loci >= 3 THEN '3-4' ELSE CAST(CAST(loci AS INTEGER) AS VARCHAR) END AS class, true_value, count(*) AS keys, CAST(sum(total) AS BIGINT) AS n FROM jn GROUP BY 1, 2""")
def sketch_by_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.regexp_replace(F.translate("text", bridge._LETTERS, bridge._BASES), "[^ACGT]", "").alias("seq"))
    return km.by_loci(_sketch(spark, sf_dir)[1], km.pairs(contigs, K, V, c=C))


# Overlaps, pileups ------------------------------------------------------------------------------------------------

_PLACE = """, pr AS (SELECT read_id AS pair_id, (7 * length(seq)) // 10 AS m, substr(seq, 1, (7 * length(seq)) // 10) AS a,
  substr(array_to_string([CASE WHEN (i * 31 + read_id * 17) % 23 = 0 THEN translate(substr(seq, i, 1), 'ACGT', 'CGTA') ELSE substr(seq, i, 1) END FOR i IN range(1, length(seq) + 1)], ''), length(seq) - (7 * length(seq)) // 10 + 1) AS b FROM reads WHERE length(seq) >= 2),
o AS (SELECT *, unnest(range(20 - m, m - 19)) AS o FROM pr), h AS (SELECT pair_id, o, m - abs(o) AS n, hamming(substr(a, 1 + greatest(o, 0), m - abs(o)), substr(b, 1 + greatest(-o, 0), m - abs(o))) AS d FROM o),
top AS (SELECT pair_id, arg_min(o, (d / n, -n, o)) AS best FROM h GROUP BY pair_id),
pl AS (SELECT pair_id, CAST(any_value(best) AS INTEGER) AS "offset", CAST(max(CASE WHEN o = best THEN n END) AS INTEGER) AS overlap, CAST(max(CASE WHEN o = best THEN d END) AS INTEGER) AS mismatches, coalesce(bool_or(abs(o - best) > 3 AND d / n < 0.35), false) AS rival FROM h JOIN top USING (pair_id) GROUP BY pair_id),
cn AS (SELECT pl.pair_id, "offset" AS o, overlap, mismatches, a, b, m FROM pl JOIN pr USING (pair_id) WHERE NOT rival AND mismatches >= 3), sh AS (SELECT unnest(range(-3, 4)) AS s),
wr AS (SELECT pair_id, s, i, o, CASE WHEN i - o - s BETWEEN 0 AND m - 1 THEN CAST(substr(a, i + 1, 1) <> substr(b, i - o - s + 1, 1) AS INTEGER) ELSE 1 END AS x FROM (SELECT *, unnest(range(greatest(0, o), least(m, o + m))) AS i FROM cn), sh),
cu AS (SELECT pair_id, s, i, sum(x) OVER (PARTITION BY pair_id, s ORDER BY i) - x AS pre, sum(x) OVER (PARTITION BY pair_id, s) AS total FROM wr),
sp AS (SELECT z.pair_id, least(min(z.pre + y.total - y.pre), min(y.pre + z.total - z.pre)) AS best FROM cu z JOIN cu y ON y.pair_id = z.pair_id AND y.i = z.i AND z.s = 0 AND y.s <> 0 GROUP BY z.pair_id),
pd AS (SELECT pair_id, "offset", coalesce(overlap, 0) AS overlap, coalesce(mismatches, 0) AS mismatches, coalesce(rival, false) AS rival,
  CASE WHEN overlap IS NULL THEN 'no_overlap' WHEN NOT rival AND best <= mismatches - 3 AND best <= 0.2 * overlap THEN 'indel' WHEN rival OR mismatches / overlap > 0.2 THEN 'no_overlap' ELSE 'placed' END AS status FROM pr LEFT JOIN pl USING (pair_id) LEFT JOIN sp USING (pair_id))"""
#: A row of each base that both mates of a placed pair read: pair_id, p1 on the first mate, m and o; q1 and q2.
PLACED_BASES = _PLACE + """, ql AS (SELECT read_id AS pair_id, list(q ORDER BY pos_start) AS q FROM bases GROUP BY read_id),
ov AS (SELECT pr.*, "offset" AS o, reverse(translate(b, 'ACGT', 'TGCA')) AS r2, q[1:m] AS q1, list_reverse(q[len(q) - m + 1:]) AS q2, unnest(range(greatest(0, "offset"), greatest(0, "offset") + overlap)) AS p1 FROM pd JOIN pr USING (pair_id) JOIN ql USING (pair_id) WHERE status = 'placed')"""
_BOTH = PLACED_BASES + """,
bt AS (SELECT substr(a, p1 + 1, 1) AS b1, substr(b, p1 - o + 1, 1) AS b2, substr('.' || a || '.', p1 + 1, 3) AS context_1, substr('.' || r2 || '.', p2 + 1, 3) AS context_2, q1[p1 + 1] AS q_1, q2[p2 + 1] AS q_2,
  CASE WHEN p1 > 0 THEN q1[p1] END AS q_m1_1, CASE WHEN p1 + 1 < m THEN q1[p1 + 2] END AS q_p1_1, CASE WHEN p2 > 0 THEN q2[p2] END AS q_m1_2, CASE WHEN p2 + 1 < m THEN q2[p2 + 2] END AS q_p1_2,
  CAST(p1 + 1 AS INTEGER) AS pos_start_1, CAST(m - p1 AS INTEGER) AS pos_end_1, CAST(p2 + 1 AS INTEGER) AS pos_start_2, CAST(m - p2 AS INTEGER) AS pos_end_2,
  CAST(10 * least(9, floor(10.0 * length(regexp_replace(a, '[^GC]', '', 'g')) / length(a))) AS INTEGER) AS gc FROM (SELECT *, m - 1 - (p1 - o) AS p2 FROM ov))"""


def _mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ov.placements(bridge.pairs(bridge.reads(spark, sf_dir)))


@query(_PLACE + ' SELECT pair_id, status, "offset", CAST(overlap AS INTEGER) AS overlap, CAST(mismatches AS INTEGER) AS mismatches, rival FROM pd')
def overlap_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mates(spark, sf_dir).select("pair_id", "status", "offset", "overlap", "mismatches", "rival")


@query(_PLACE + """ SELECT count(*) AS pairs, count(*) FILTER (status = 'no_overlap') AS no_overlap, count(*) FILTER (status = 'indel') AS indel, CAST(coalesce(sum(overlap - mismatches) FILTER (status = 'placed'), 0) AS BIGINT) AS agree, CAST(coalesce(sum(mismatches) FILTER (status = 'placed'), 0) AS BIGINT) AS disagree FROM pd""")
def overlap_agree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ov.agreement(_mates(spark, sf_dir))


@query(_BOTH + """, e AS (SELECT q_1 AS q, q_m1_1 AS q_m1, q_p1_1 AS q_p1, context_1 AS context, pos_start_1 AS pos_start, pos_end_1 AS pos_end, 1 AS mate, '+' AS strand, gc FROM bt WHERE b1 = b2 UNION ALL SELECT q_2, q_m1_2, q_p1_2, context_2, pos_start_2, pos_end_2, 2, '-', gc FROM bt WHERE b1 = b2)
SELECT *, '=' AS op, count(*) AS n FROM e GROUP BY ALL""")
def overlap_certain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ov.certain(_mates(spark, sf_dir).filter("status = 'placed'"), flank=(1, 1)).df


@query(_BOTH + " SELECT *, count(*) AS n FROM bt WHERE b1 <> b2 GROUP BY ALL")
def overlap_disputed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ov.disputed(_mates(spark, sf_dir).filter("status = 'placed'"), flank=(1, 1))


_SITES = """, pile AS (SELECT source AS contig, CAST(site - 1 AS BIGINT) AS site, called AS allele, count(*) AS n FROM obs GROUP BY ALL),
st AS (SELECT contig, site, CAST(sum(n) AS BIGINT) AS depth, coalesce(list_reverse_sort(list(n))[2], 0) AS top_alt FROM pile GROUP BY contig, site)"""


def _piled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.pileup(bridge.alignments(bridge.reads(spark, sf_dir)))


@query(_SITES + " SELECT contig, site, allele, n FROM pile")
def pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _piled(spark, sf_dir)


@query(_SITES + " SELECT contig, site FROM st WHERE top_alt >= 2 AND top_alt >= 0.3 * depth")
def site_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.site_masks(al.sites(_piled(spark, sf_dir)), freq=0.3)


@query(_SITES + " SELECT contig, count(*) AS sites, round(avg(depth), 6) AS mean_depth, count(*) FILTER (top_alt >= 2 AND top_alt >= 0.3 * depth) AS masked, avg(depth) >= 5 AS kept FROM st GROUP BY contig")
def contig_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(al.contig_report(al.sites(_piled(spark, sf_dir)), freq=0.3), "mean_depth")


@query(_SITES + """, md AS (SELECT contig, median(depth) AS m FROM st GROUP BY contig) SELECT contig, site, depth < 5 AS low, depth > 2 * m OR depth < m / 2 AS copies FROM st JOIN md USING (contig) WHERE depth < 5 OR depth > 2 * m OR depth < m / 2""")
def coverage_single_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.single_copy(al.sites(_piled(spark, sf_dir)))


@query(""", sub AS (SELECT read_id, source AS contig, site, called AS allele FROM obs WHERE op <> '=')
SELECT a.contig, a.site AS site_a, a.allele AS allele_a, b.site AS site_b, b.allele AS allele_b, count(*) AS n FROM sub a JOIN sub b ON a.read_id = b.read_id AND a.contig = b.contig AND a.site < b.site GROUP BY ALL HAVING count(*) >= 3""")
def linked_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.linked_reads(bridge.placed(bridge.reads(spark, sf_dir)).withColumn("start", F.col("start") + 1))


@query(_WINDOWED + " SELECT q, q_m1, q_p1, context, pos_start, pos_end, mate, op, count(*) AS n FROM w GROUP BY ALL")
def walked_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table from alignments, whose reads may also have gaps, clips and masks."""
    table = al.observation_table(bridge.alignments(bridge.reads(spark, sf_dir)), flank=(1, 1), m=1)
    return table.marginal("q", "q_m1", "q_p1", "context", "pos_start", "pos_end", "mate", "op").df


# Read sets beside each other ----------------------------------------------------------------------------------------

_CLASS = "CASE WHEN op = '=' THEN 'match' WHEN op LIKE '-%' THEN 'ins' WHEN op LIKE '%-' THEN 'del' ELSE 'sub' END"
_DISTANCES = _WINDOWED + f""", g AS (SELECT *, {_CLASS} AS class, doc_id % 3 AS grp FROM w),
ax AS (SELECT grp, 'rate' AS name, '' AS value, class <> 'match' AS e FROM g UNION ALL SELECT grp, 'substitution_rate', '', class = 'sub' FROM g UNION ALL SELECT grp, 'rate_by_q', CAST(q AS VARCHAR), class <> 'match' FROM g
  UNION ALL SELECT grp, 'rate_by_cycle', CAST(pos_start AS VARCHAR), class <> 'match' FROM g UNION ALL SELECT grp, 'substitution_by_context', context, class = 'sub' FROM g),
rt AS (SELECT grp, name, value, count(*) AS n, count(*) FILTER (e) AS x FROM ax GROUP BY grp, name, value),
rd AS (SELECT b.grp, name, sum(a.n * abs(ln((b.x + 0.5) / (b.n + 1)) - ln((a.x + 0.5) / (a.n + 1)))) / sum(a.n) AS distance FROM rt a JOIN rt b USING (name, value) WHERE a.grp = 0 AND b.grp > 0 GROUP BY b.grp, name),
qc AS (SELECT grp, pos_start, q, count(*) AS c FROM g GROUP BY grp, pos_start, q), qs AS (SELECT *, sum(c) OVER (PARTITION BY grp, pos_start) AS n FROM qc), qv AS (SELECT DISTINCT q FROM qc), cy AS (SELECT DISTINCT a.pos_start, a.n, b.grp FROM qs a JOIN qs b USING (pos_start) WHERE a.grp = 0 AND b.grp > 0),
tv AS (SELECT cy.grp, cy.pos_start, any_value(cy.n) AS n, sum(abs(coalesce(a.c / a.n, 0) - coalesce(b.c / b.n, 0))) / 2 AS tv FROM cy CROSS JOIN qv LEFT JOIN qs a ON a.grp = 0 AND a.pos_start = cy.pos_start AND a.q = qv.q LEFT JOIN qs b ON b.grp = cy.grp AND b.pos_start = cy.pos_start AND b.q = qv.q GROUP BY cy.grp, cy.pos_start),
lg AS (SELECT grp, corr(q_m1, q) AS r FROM g WHERE q_m1 IS NOT NULL GROUP BY grp),
ds AS (SELECT * FROM rd UNION ALL SELECT grp, 'q_cycle_tv', sum(n * tv) / sum(n) FROM tv GROUP BY grp UNION ALL SELECT b.grp, 'q_lag1', abs(a.r - b.r) FROM lg a, lg b WHERE a.grp = 0 AND b.grp > 0)"""


@query(_DISTANCES + """ SELECT name, round(a.distance, 6) AS ours, round(b.distance, 6) AS theirs, CASE WHEN abs(a.distance - b.distance) <= greatest(0.01, 0.1 * greatest(a.distance, b.distance)) THEN 'matches' WHEN a.distance < b.distance THEN 'beats' ELSE 'trails' END AS verdict
FROM ds a JOIN ds b USING (name) WHERE a.grp = 1 AND b.grp = 2""")
def profile_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three thirds of the texts as the real reads, ours and theirs."""
    rows = Stages(spark, "profiles").write(counted(_observed(spark, sf_dir).withColumn("group", F.col("doc_id") % 3), ["group", "q", "q_m1", "pos_start", "context", "op"]), "rows")
    return _rounded(cp.verdicts(*(rows.filter(F.col("group") == k) for k in range(3))), "ours", "theirs")


@query(_WINDOWED + " SELECT context, op, count(*) AS n FROM w WHERE op <> '=' GROUP BY ALL")
def error_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.error_contexts(_table(_observed(spark, sf_dir), "context", "op"), (1, 1))


@query(_WINDOWED + ", c AS (SELECT context, count(*) AS n FROM w WHERE op <> '=' GROUP BY ALL) SELECT context, round(n / (SELECT sum(n) FROM c), 6) AS share FROM c ORDER BY n DESC, context LIMIT 8")
def top_error_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the report's."""
    return _rounded(cp.top_contexts(_table(_observed(spark, sf_dir), "context", "op").df.filter("op != '='")), "share")


@query(""", c AS (SELECT op, base AS template, CASE WHEN pos_start > 95 THEN '.' WHEN site % 29 = 0 THEN translate(base, 'ACGT', 'GTAC') ELSE base END AS consensus FROM obs),
l AS (SELECT CASE WHEN op <> '=' THEN 'error' WHEN consensus = '.' THEN 'adapter' WHEN template <> consensus THEN 'variant' ELSE 'match' END AS label FROM c)
SELECT count(*) AS bases, round(avg(CAST(label = 'match' AS INTEGER)), 6) AS "match", round(avg(CAST(label = 'variant' AS INTEGER)), 6) AS variant, round(avg(CAST(label = 'error' AS INTEGER)), 6) AS error, round(avg(CAST(label = 'adapter' AS INTEGER)), 6) AS adapter FROM l""")
def label_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _placed(spark, sf_dir)
    consensus = F.when(F.col("pos_start") > 95, ".").when((F.col("site") + 1) % 29 == 0, F.translate("base", "ACGT", "GTAC")).otherwise(F.col("base"))
    return _rounded(cp.label_shares(rows.select("op", F.col("base").alias("template"), consensus.alias("consensus"))), "match", "variant", "error", "adapter")


@query(_SITES + """, m AS (SELECT contig, site FROM st WHERE top_alt >= 2 AND top_alt >= 0.3 * depth), o AS (SELECT q, op, source AS contig, site - 1 AS site FROM obs)
SELECT CASE WHEN m.site IS NULL THEN 'kept' ELSE 'dropped' END AS side, q, count(*) AS bases, round(count(*) FILTER (op <> '=') / count(*), 6) AS mismatch_rate FROM o LEFT JOIN m ON o.contig = m.contig AND o.site = m.site GROUP BY ALL""")
def quality_at_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cp.quality_at_masks(_observed_counts(spark, sf_dir, "contig", "site", "op", "q"), al.site_masks(al.sites(_piled(spark, sf_dir)), freq=0.3)), "mismatch_rate")


@query(_SITES + """, m AS (SELECT contig, site FROM st WHERE top_alt >= 2 AND top_alt >= 0.3 * depth), k AS (SELECT contig FROM st GROUP BY contig HAVING avg(depth) >= 5)
SELECT source AS contig, op, q, count(*) AS n FROM obs WHERE source IN (SELECT contig FROM k) AND NOT EXISTS (SELECT 1 FROM m WHERE m.contig = source AND m.site = obs.site - 1) GROUP BY ALL""")
def masked_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Stages(spark, "sites").write(al.sites(_piled(spark, sf_dir)), "sites")  # read for the masks and for the report
    rows = _observed_counts(spark, sf_dir, "contig", "site", "op", "q")
    return counted(al.unmasked(rows, al.site_masks(at, freq=0.3), al.contig_report(at, freq=0.3).filter("kept")), ["contig", "op", "q"], "n")


@query(_SITES + """, md AS (SELECT contig, median(depth) AS m FROM st GROUP BY contig), fl AS (SELECT contig, site, depth < 5 AS low, depth > 2 * m OR depth < m / 2 AS copies FROM st JOIN md USING (contig)),
sub AS (SELECT read_id, source AS contig, CAST(site - 1 AS BIGINT) AS site, called AS allele FROM obs WHERE op <> '='), lk AS (SELECT a.contig, a.site AS x, b.site AS y FROM sub a JOIN sub b ON a.read_id = b.read_id AND a.contig = b.contig AND a.site < b.site GROUP BY a.contig, a.site, a.allele, b.site, b.allele HAVING count(*) >= 3),
en AS (SELECT contig, x AS site FROM lk UNION SELECT contig, y FROM lk), al AS (SELECT * FROM fl WHERE low OR copies)
SELECT contig, site, CASE WHEN low THEN 'low' WHEN copies THEN 'copies' ELSE 'linked' END AS reason FROM al FULL JOIN en USING (contig, site)""")
def conservative_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = al.linked_reads(bridge.placed(bridge.reads(spark, sf_dir)))
    return al.conservative(al.sites(_piled(spark, sf_dir)), links)


@query(""", h AS (SELECT CAST(floor(20.0 * length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq)) AS INTEGER) * 5 AS lo FROM reads), b AS (SELECT least(lo, 95) AS lo FROM h) SELECT lo // 10 * 10 AS gc, count(*) AS n FROM b GROUP BY 1""")
def gc_bins_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five per cent bins, pooled into ten per cent ones."""
    share = F.length(F.regexp_replace("seq", "[^GC]", "")) * 20 / F.length("seq")
    fine = counted(bridge.reads(spark, sf_dir).select(F.least(F.floor(share).cast("int") * 5, F.lit(95)).alias("gc")), ["gc"])
    return counted(fine.select(gc_ten(F.col("gc"), F.col("gc") + 5).alias("gc"), "n"), ["gc"], "n")


@query(" SELECT q, op, 2 AS mate, count(*) AS n FROM obs GROUP BY q, op")
def table_with_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(_observed(spark, sf_dir), "q", "mate", "op").with_key("mate", 2).df


# Exporters --------------------------------------------------------------------------------------------------------


@query(""", c AS (SELECT base AS symbol, pos_start AS pos, least(q, 41) AS q, count(*) AS n FROM bases GROUP BY ALL UNION ALL SELECT '.', pos_start, least(q, 41), count(*) FROM bases GROUP BY ALL)
SELECT symbol, pos, q, CAST(sum(n) OVER (PARTITION BY symbol, pos ORDER BY q) AS BIGINT) AS cumulative FROM c""")
def art_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.art_profile(ba.bases(bridge.reads(spark, sf_dir)))


@query(""", m AS (SELECT read_id, CAST(floor(least(3, avg(q) / 10)) AS INTEGER) AS bin FROM bases GROUP BY read_id), c AS (SELECT bin, pos_start AS pos, least(q, 40) AS q, count(*) AS n FROM bases JOIN m USING (read_id) GROUP BY ALL)
SELECT bin, pos, q, round(sum(n) OVER (PARTITION BY bin, pos ORDER BY q) / sum(n) OVER (PARTITION BY bin, pos), 6) AS cdf FROM c""")
def iss_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ex.mean_quality_cdf(bridge.reads(spark, sf_dir)), "cdf")


@query(""", calls AS (SELECT read_id, seq AS template, string_agg(called, '' ORDER BY pos_start) AS seq FROM obs GROUP BY read_id, seq),
w AS (SELECT substr(template, i, 7) AS kmer, substr(seq, i, 7) AS alternative FROM (SELECT template, seq, unnest(range(1, length(seq) - 5)) AS i FROM calls WHERE length(seq) >= 7)),
c AS (SELECT kmer, alternative, count(*) AS n FROM w WHERE substr(kmer, 1, 1) = substr(alternative, 1, 1) AND substr(kmer, 7) = substr(alternative, 7) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY kmer ORDER BY n DESC, alternative) AS INTEGER) AS rank FROM c) SELECT kmer, alternative, n, rank FROM r WHERE rank <= 25""")
def kmer_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap of 25 is the exported format's."""
    return ex.kmer_alternatives(bridge.called(bridge.reads(spark, sf_dir)))


@query(""", s AS (SELECT q AS state, lead(q) OVER (PARTITION BY read_id ORDER BY pos_start) AS following FROM bases), c AS (SELECT state, following, count(*) AS n FROM s WHERE following IS NOT NULL GROUP BY ALL)
SELECT state, following, n, round(n / sum(n) OVER (PARTITION BY state), 6) AS share FROM c""")
def quality_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ex.chain(bridge.reads(spark, sf_dir)), "share")


@query(""" SELECT round(count(*) FILTER (op <> '=' AND op NOT LIKE '%-%') / count(*) FILTER (op <> '='), 6) AS sub, round(count(*) FILTER (op LIKE '-%') / count(*) FILTER (op <> '='), 6) AS ins, round(count(*) FILTER (op LIKE '%-') / count(*) FILTER (op <> '='), 6) AS del FROM obs""")
def difference_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ex.difference_ratio(_table(_observed(spark, sf_dir), "op").df), "sub", "ins", "del")


@query(""", c AS (SELECT q, count(*) AS n, count(*) FILTER (op <> '=') AS e FROM obs GROUP BY q), p AS (SELECT sum(e) / sum(n) AS r FROM c)
SELECT q, CAST(least(41, greatest(1, round(-10 * log10((e + 1) / (n + 1 / r))))) AS INTEGER) AS remapped FROM c, p""")
def quality_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.remap(_table(_observed(spark, sf_dir), "q", "op").df)


def _strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column strings of the bridge's alignments, in which nothing has a gap."""
    return bridge.strings(bridge.reads(spark, sf_dir))


_STRINGS = """, st AS (SELECT read_id, string_agg(CASE op WHEN '=' THEN '=' ELSE 'X' END, '' ORDER BY pos_start) AS ops, list(q ORDER BY pos_start) AS qs FROM obs GROUP BY read_id)"""


@query(_STRINGS + """, w AS (SELECT ops, qs, k, unnest(range(1, length(ops) - k + 2)) AS j FROM st, (SELECT unnest([1, 3, 5, 7, 9]) AS k) WHERE length(ops) >= k),
c AS (SELECT substr(ops, j, k) AS cigar, qs[j + k // 2] AS q, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT cigar, sum(n) AS total FROM c GROUP BY cigar)
SELECT cigar, q, n FROM c JOIN t USING (cigar) WHERE length(cigar) = 1 OR total >= 100 UNION ALL SELECT 'overall', q, CAST(sum(n) AS BIGINT) FROM c WHERE length(cigar) = 1 GROUP BY q""")
def qscore_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without gaps there are fewer windows than the format's limit of 10,000, so the oracle doesn't rank them."""
    return ex.qscore_model(_strings(spark, sf_dir))


@query(" SELECT read_id, round(count(*) FILTER (op = '=') / count(*), 6) AS identity FROM obs GROUP BY read_id")
def read_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ex.identities(_strings(spark, sf_dir)), "identity")


_CHAIN = """, u AS (SELECT row_number() OVER (ORDER BY v) - 1 AS s, v FROM (SELECT DISTINCT v FROM x)), m AS (SELECT lag(s) OVER (PARTITION BY read_id ORDER BY pos_start) AS a, s AS b FROM x JOIN u USING (v))
SELECT 'IP' AS kind, CAST(b AS INTEGER) AS state, CAST(NULL AS INTEGER) AS target, round(count(*) / sum(count(*)) OVER (), 6) AS p FROM m WHERE a IS NULL GROUP BY b
UNION ALL SELECT 'TP', CAST(a AS INTEGER), CAST(b AS INTEGER), round(count(*) / sum(count(*)) OVER (PARTITION BY a), 6) FROM m WHERE a IS NOT NULL GROUP BY a, b """


@query(", x AS (SELECT read_id, pos_start, q AS v FROM bases)" + _CHAIN + " UNION ALL SELECT 'EP', CAST(s AS INTEGER), v, 1.0 FROM u")
def quality_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ex.quality_hmm(bridge.reads(spark, sf_dir)), "p")


@query(", x AS (SELECT read_id, pos_start, CAST(op <> '=' AS INTEGER) AS v FROM obs), pl AS (SELECT v, count(*) AS n FROM x GROUP BY v)" + _CHAIN + """
UNION ALL SELECT 'TP', g.s, v, round(n / sum(n) OVER (PARTITION BY g.s), 6) FROM pl, (SELECT unnest([2, 3]) AS s) g UNION ALL SELECT 'EP', s, s, 1.0 FROM (SELECT unnest([0, 1, 2, 3]) AS s)""")
def error_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ex.error_hmm(_strings(spark, sf_dir)), "p")


@query(""", c AS (SELECT mate, pos_start AS pos, base, called AS alt, count(*) AS n FROM obs WHERE op <> '=' GROUP BY ALL)
SELECT mate, pos, base, alt, round(n / sum(n) OVER (PARTITION BY mate, pos, base), 6) AS p FROM c""")
def iss_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observed(spark, sf_dir).select("mate", F.lit("M").alias("op"), F.col("pos_start").alias("pos"), F.col("base").alias("ref"), F.col("called").alias("alt"))
    tables = ex.mate_tables(Stages(spark, "substitutions").write(counted(rows, ["mate", "op", "pos", "ref", "alt"]), "rows"))
    return _rounded(tables.filter("kind = 'sub'").drop("kind"), "p")


# Gaps: the walk kernel on reads with a planted deletion and insertion -----------------------------------------------


def _gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of 41 bases or more with bases 21-22 of the template deleted, and AC put in behind its base 40; shorter ones as they are."""
    rows = bridge.alignments(bridge.reads(spark, sf_dir))
    long = F.length("template") > 40
    cut = lambda c, put: F.when(long, F.concat(F.substring(c, 1, 20), F.substring(c, 23, 18), F.lit(put), F.substring(c, F.lit(41), F.length(c)))).otherwise(F.col(c))
    cigar = F.when(long, F.concat(F.lit("20M2D18M2I"), F.length("template") - 40, F.lit("M"))).otherwise(F.concat(F.length("template").cast("string"), F.lit("M")))
    return rows.withColumns({"sequence": cut("template", "AC"), "quality": cut("quality", "5I"), "cigar": cigar})


_GAPS = """, g AS (SELECT *, length(seq) > 40 AS gap, CASE WHEN length(seq) > 40 THEN substr(seq, 1, 20) || substr(seq, 23, 18) || 'AC' || substr(seq, 41) ELSE seq END AS own FROM reads),
c AS (SELECT read_id, mate, seq, own, gap, unnest(range(1, length(seq) + CASE WHEN gap THEN 3 ELSE 1 END)) AS i FROM g),
k AS (SELECT *, CASE WHEN gap AND i IN (21, 22) THEN 'D' WHEN gap AND i IN (41, 42) THEN 'I' ELSE 'M' END AS op, CASE WHEN NOT gap OR i <= 40 THEN i WHEN i > 42 THEN i - 2 END AS t, CASE WHEN NOT gap OR i <= 20 THEN i WHEN i <= 22 THEN 21 ELSE i - 2 END AS r FROM c)"""


@query(_GAPS + """ SELECT mate, op, CAST(r AS INTEGER) AS pos, CASE WHEN op = 'I' THEN '-' ELSE substr(seq, t, 1) END AS ref, CASE WHEN op = 'D' THEN '-' ELSE substr(own, r, 1) END AS alt, count(*) AS n FROM k GROUP BY ALL""")
def alignment_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.column_counts(_gapped(spark, sf_dir), ["mate", "op", "pos", "ref", "alt"])


@query(_GAPS + """, a AS (SELECT mate, r AS pos, substr(seq, t, 1) AS base, count(*) AS there, count(*) FILTER (op = 'D') AS gone FROM k WHERE op <> 'I' GROUP BY ALL), p AS (SELECT mate, pos, sum(there) AS there FROM a GROUP BY ALL),
i AS (SELECT mate, greatest(r - 1, 1) AS pos, substr(own, r, 1) AS base, count(*) AS n FROM k WHERE op = 'I' GROUP BY ALL)
SELECT 'ins' AS kind, mate, CAST(pos AS INTEGER) AS pos, base, round(n / there, 6) AS p FROM i JOIN p USING (mate, pos) UNION ALL SELECT 'del', mate, CAST(pos AS INTEGER), base, round(gone / there, 6) FROM a WHERE gone > 0""")
def iss_indel_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = Stages(spark, "columns").write(al.column_counts(_gapped(spark, sf_dir), ["mate", "op", "pos", "ref", "alt"]), "columns")
    return _rounded(ex.mate_tables(columns).filter("kind <> 'sub'").drop("alt"), "p")


@query(""", g AS (SELECT seq FROM reads WHERE length(seq) > 40), e AS (SELECT seq, 'D' AS indel, 21 AS t FROM g UNION ALL SELECT seq, 'I', 41 FROM g),
b AS (SELECT *, substr(seq, t, 1) AS x FROM e), r AS (SELECT indel, length(regexp_extract(reverse(substr(seq, 1, t)), '^' || x || '+')) + length(regexp_extract(substr(seq, t), '^' || x || '+')) - 1 AS run FROM b)
SELECT indel, 2 AS indel_length, CAST(run AS INTEGER) AS run, count(*) AS n FROM r GROUP BY ALL""")
def indel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shorter reads have no events, whatever is planted."""
    return counted(al.indel_events(_gapped(spark, sf_dir)), ["indel", "indel_length", "run"], "n")


@query(""", o AS (SELECT q, lead(q, 2) OVER (PARTITION BY read_id ORDER BY pos_start) AS later, base, pos_start AS t, length(seq) > 40 AS gap, substr('.' || seq || '.', pos_start, 3) AS context FROM bases),
e AS (SELECT q, context, '=' AS op FROM o WHERE NOT (gap AND t IN (21, 22)) UNION ALL SELECT later, context, base || '>-' FROM o WHERE gap AND t = 21 UNION ALL SELECT q, context, '->A' FROM o WHERE gap AND t = 41)
SELECT q, context, op, count(*) AS n FROM e GROUP BY ALL""")
def gapped_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a gap its first base alone counts."""
    return al.observation_counts(_gapped(spark, sf_dir), ["q", "context", "op"], flank=(1, 1), per_event=True)


@query(_GAPS + """, w AS (SELECT k.*, CASE WHEN op = 'I' THEN CASE i WHEN 41 THEN 20 ELSE 40 END ELSE b.q END AS q FROM k LEFT JOIN bases b ON b.read_id = k.read_id AND b.pos_start = CASE WHEN op = 'D' THEN 23 ELSE t END),
x AS (SELECT 'substitution' AS kind, op = 'M' AS exposed, false AS error, q FROM w UNION ALL SELECT 'any', op <> 'D', op <> 'M', q FROM w)
SELECT kind, count(*) FILTER (exposed) AS exposure, count(*) FILTER (error) AS errors, round(count(*) FILTER (error) / count(*) FILTER (exposed), 6) AS rate, round(sum(pow(10, -q / 10)) FILTER (exposed) / count(*) FILTER (exposed), 6) AS implied FROM x GROUP BY kind""")
def column_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps are the only edits of these reads."""
    columns = al.column_counts(_gapped(spark, sf_dir), ["op", "ref", "alt", "q"])
    return _rounded(ev.column_rates(columns), "rate", "implied")


_HALVES = """, hr AS (SELECT *, doc_id % 2 AS grp FROM reads WHERE length(seq) >= 15), km AS (SELECT grp, substr(seq, i, 15) AS w FROM (SELECT grp, seq, unnest(range(1, length(seq) - 13)) AS i FROM hr)),
kc AS (SELECT grp, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM km GROUP BY ALL), kn AS (SELECT DISTINCT kmer FROM kc WHERE md5(kmer) < '8'),
sp AS (SELECT grp, least(n, 50) AS value, count(*) AS c FROM kc GROUP BY ALL), rb AS (SELECT doc_id % 2 AS grp, least(floor(count(*) FILTER (op <> '=') / count(*) / 0.002), 50) AS value FROM obs GROUP BY read_id, doc_id % 2), rc AS (SELECT grp, value, count(*) AS c FROM rb GROUP BY ALL),
hs AS (SELECT 'kmer_spectrum_tv' AS name, * FROM sp UNION ALL SELECT 'read_error_rate_tv', * FROM rc), hp AS (SELECT name, grp, value, c / sum(c) OVER (PARTITION BY name, grp) AS p FROM hs),
tv AS (SELECT name, sum(abs(coalesce(a, 0) - coalesce(b, 0))) / 2 AS distance FROM (SELECT name, value, max(CASE WHEN grp = 0 THEN p END) AS a, max(CASE WHEN grp = 1 THEN p END) AS b FROM hp GROUP BY ALL) GROUP BY name),
ab AS (SELECT grp, sum(CASE WHEN kn.kmer IS NULL THEN n ELSE 0 END) / sum(n) AS share FROM kc LEFT JOIN kn USING (kmer) GROUP BY grp)"""


@query(_HALVES + """ SELECT name, round(distance, 6) AS distance FROM tv UNION ALL SELECT 'kmer_absent', round(abs(ln(max(CASE WHEN grp = 1 THEN share END) / max(CASE WHEN grp = 0 THEN share END))), 6) FROM ab""")
def profile_kmer_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of even and of odd ids as two read sets; k-mers whose checksum is low are the known ones."""
    reads, observed = bridge.reads(spark, sf_dir), _observed(spark, sf_dir)
    sides = []
    for k in range(2):
        counts = Stages(spark, "kmers").write(km.kmers(reads.filter(F.col("doc_id") % 2 == k), 15), "counts")
        sides.append((counts, ev.read_rates(observed.filter(F.col("doc_id") % 2 == k).withColumn("n", F.lit(1)))))
    known = sides[0][0].select("kmer").unionByName(sides[1][0].select("kmer")).distinct().filter(F.md5("kmer") < "8")
    return _rounded(cp.kmer_distances(*sides, known), "distance")


@query(_PAIRS + f""", ak AS (SELECT key, t, CAST(sum(n) AS BIGINT) AS n FROM kv JOIN best USING (key) JOIN ts ON substr(value, 1, t) = substr(consensus, 1, t) GROUP BY ALL),
rl AS (SELECT a.key, a.t + 1 AS t, a.n AS at_risk, a.n - coalesce(b.n, 0) AS lost FROM ak a LEFT JOIN ak b ON b.key = a.key AND b.t = a.t + 1 WHERE a.t < {V}), hh AS (SELECT t, least(greatest(sum(lost) / greatest(sum(at_risk), 1), 1e-9), 0.5) AS p FROM rl GROUP BY t),
tl AS (SELECT key, CAST(t AS INTEGER) AS t, at_risk, lost, list_sum(list_transform(range(lost, at_risk + 1), lambda j: exp(lgamma(at_risk + 1) - lgamma(j + 1) - lgamma(at_risk - j + 1) + j * ln(p) + (at_risk - j) * ln(1 - p)))) AS tail FROM rl JOIN hh USING (t) WHERE lost > 0)
SELECT key, t, at_risk, lost FROM tl WHERE tail < 0.01""")
def kvmer_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of the outlier test. Texts' hazards are so high that the usual bound finds nothing; this one is 0.01."""
    alive = km.survival(*_sketch(spark, sf_dir), V)
    return km.outliers(alive, 0.01, turns=1).drop("tail")


# Estimators: driver-side iterations over Spark aggregates ---------------------------------------------------------


def _scored(spark: SparkSession, head: Head, df: DataFrame, by: list[str]) -> DataFrame:
    """Expected and measured error rates of a fitted head by some covariates."""
    rows, counts = head.gather(df)
    import numpy as np

    p = np.exp(head.log_probabilities(rows))
    n = counts.sum(axis=1)
    table = rows[by].assign(n=n, expected=n * (1 - p[:, 0]), errors=counts[:, 1:].sum(axis=1)).groupby(by, as_index=False).sum()
    return spark.createDataFrame(table)


@query()
def fit_head_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, n, expected, errors): the error head's rates beside the measured ones."""
    table = _table(_observed(spark, sf_dir), "q", "context", "mate", "op").df
    head = Head("E", ["QualityWindow(0)", "Context(1,1)", "Mate"], bridge.QUALITIES, (1, 1), bridge.WIDTH)
    head.fit(*head.gather(table), Penalty(smooth=30))
    return _scored(spark, head, table, ["q"])


@query()
def fit_head_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q_m1, q, p): the quality head's transitions, averaged over the rows."""
    import numpy as np
    import pandas as pd

    table = ba.base_counts(bridge.reads(spark, sf_dir), ["q_m1", "mate", "context", "q"])
    head = Head("Q", ["QualityMarkov(1)", "Mate", "Context(0,0)"], bridge.QUALITIES, (0, 0), bridge.WIDTH)
    rows, counts = head.gather(table)
    head.fit(rows, counts)
    p, n = np.exp(head.log_probabilities(rows)), counts.sum(axis=1)
    out = pd.DataFrame(p * n[:, None], columns=list(bridge.QUALITIES)).assign(q_m1=rows["q_m1"].fillna(-1).astype(int), n=n).groupby("q_m1", as_index=False).sum()
    return spark.createDataFrame([(int(r["q_m1"]), q, float(r[q] / r["n"])) for _, r in out.iterrows() for q in bridge.QUALITIES], "q_m1 int, q int, p double")


def _ipf_sql(rounds: int) -> str:
    """Errors of cells of quality and position from the margins' product, scaled to qualities and then to positions, so many rounds."""
    parts = [""", c AS (SELECT q, pos_start AS pos, count(*) AS n, count(*) FILTER (op <> '=') AS x FROM obs GROUP BY ALL),
mq AS (SELECT q, sum(x) AS want, sum(n) AS n FROM c GROUP BY q), mp AS (SELECT pos, sum(x) AS want, sum(n) AS n FROM c GROUP BY pos), lv AS (SELECT sum(want) AS level FROM mq),
s0 AS (SELECT q, pos, c.n, c.n * (mq.want / mq.n) * (mp.want / mp.n) AS e FROM c JOIN mq USING (q) JOIN mp USING (pos)), e0 AS (SELECT * REPLACE (e * (SELECT level FROM lv) / (SELECT sum(e) FROM s0) AS e) FROM s0)"""]  # fmt: skip
    for i in range(rounds):
        parts.append(f"""h{i} AS (SELECT s.* REPLACE (coalesce(s.e * want / nullif(sum(s.e) OVER (PARTITION BY s.q), 0), 0) AS e) FROM e{i} s JOIN mq USING (q)),
e{i + 1} AS (SELECT s.* REPLACE (coalesce(s.e * want / nullif(sum(s.e) OVER (PARTITION BY s.pos), 0), 0) AS e) FROM h{i} s JOIN mp USING (pos))""")
    return ", ".join(parts) + f" SELECT q, pos AS pos_start, round(least(e, n), 6) AS errors FROM e{rounds}"


@query(_ipf_sql(3))
def ipf_rake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, pos_start, errors): a table of quality and position raked to its margins, three rounds, which is what SQL can follow."""
    table = _table(_observed(spark, sf_dir), "q", "pos_start", "op").exposure("q", "pos_start").toArrow().to_pandas()
    cells = table.pivot(index="q", columns="pos_start", values="n").fillna(0)
    wrong = table.pivot(index="q", columns="pos_start", values="errors").fillna(0)
    raked = rake.ipf(cells.to_numpy(float), {0: wrong.sum(axis=1).to_numpy(float), 1: wrong.sum(axis=0).to_numpy(float)}, rounds=3)
    rows = [(int(q), int(p), float(raked[i, j])) for i, q in enumerate(cells.index) for j, p in enumerate(cells.columns) if cells.iat[i, j]]
    return _rounded(spark.createDataFrame(rows, "q int, pos_start int, errors double"), "errors")


@query()
def realign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cigar, n): the gapped reads aligned anew to their templates, gaps as far left as they go."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            found = ra.align_many(batch.column("template").to_pylist(), batch.column("sequence").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([f.cigar for f in found], pa.string())], names=["cigar"])

    return counted(_gapped(spark, sf_dir).select("template", "sequence").mapInArrow(run, "cigar string"), ["cigar"])


@query(" SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extra beside the read analytics: the batch form of the streaming count table."""
    rows = sc.windowed(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return _rounded(rows.withColumn("start", F.col("start").cast("timestamp_ntz")), "value", digits=4)


from . import em_queries, loci_queries  # noqa: E402, F401  they register theirs
