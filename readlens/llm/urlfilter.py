"""URL rules by a sort-merge range join: DataFrame functions only.

A rule's host, its labels reversed, is a prefix of the reversed hosts that it fits, so each rule host is an interval of
keys: from `net.example.` to just before `net.example/`. Intervals of prefixes nest. Rule starts and urls are sorted by
key and swept; each start brings along the stack of rules that are open there, so the last start before a url has the
stack, and rules whose interval has ended or whose path doesn't fit are popped by a filter. Of those that stay the
longest wins.

The sweep must not bring one host's urls to one task. Urls are dealt into `lanes` by a hash of the row; each lane sweeps
all rule starts, of which there are (rules x lanes). So a hot host spreads over all lanes, and no url is moved twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: '/' follows '.' in byte order: what starts with `a.b.` is at least `a.b.` and less than `a.b/`.
_DOT, _AFTER_DOT = ".", "/"
#: Urls that one lane sweeps, about.
LANE_ROWS = 2_000_000


def _rest(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    return F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def sort_key(host: Column) -> Column:
    """The labels of a host in reverse, each with a dot behind it."""
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), _DOT), F.lit(_DOT))


def _stacks(rules: DataFrame) -> DataFrame:
    """(start, stack): for each distinct rule host, the rules of it and of the hosts above it.

    The hosts above are the key's own prefixes, so this is an equi-join of rules with rules and not a range join.
    """
    keyed = rules.select("host", "path", "action", sort_key(F.col("host")).alias("start")).distinct()
    hosts = keyed.select("start").distinct()
    labels = F.split(F.col("start"), "[.]")
    depth = F.size(labels) - 1
    above = hosts.select("start", F.explode(F.transform(F.sequence(F.lit(1), depth), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), _DOT), F.lit(_DOT)))).alias("open"))
    own = keyed.withColumnRenamed("start", "open")
    entry = F.struct(
        F.length(F.concat("host", "path")).alias("size"), F.concat("host", "path").alias("rule"), "action", "path",
        F.concat(F.rtrim(F.col("open"), F.lit(_DOT)), F.lit(_AFTER_DOT)).alias("end"),
    )
    return above.join(own, "open").groupBy("start").agg(F.collect_list(entry).alias("stack"))


def judge(df: DataFrame, rules: DataFrame, otherwise: str = "allow", lanes: int | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of df.

    rules: host, path, action; none of them null. A rule fits its host and all subdomains if the url's path starts with
    its own. The longest rule (host and path) wins, and of equals the one last in byte order. A url that is null or has
    no `://` has an empty host and path and fits no rule. Without a rule that fits, rule is null and the verdict is
    `otherwise`. Rows keep their number; null and repeated ids and urls are judged each by themselves. lanes: by default
    one for each LANE_ROWS urls, and at least four for each shuffle partition of the session, for even tasks.
    """
    spark = df.sparkSession
    urls = df.select(df[id_col].alias("__id"), df[url_col].alias("__url"))
    if lanes is None:
        lanes = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.select(F.lit(1)).count() // LANE_ROWS))
    lane = F.pmod(F.xxhash64("__id", "__url", F.monotonically_increasing_id()), F.lit(lanes)).cast("int")
    points = urls.select(
        lane.alias("lane"), sort_key(host_of(F.col("__url"))).alias("key"), F.lit(1).alias("is_url"), "__id",
        host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"),
    )
    starts = _stacks(rules).select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.col("start").alias("key"), F.lit(0).alias("is_url"), "stack")
    swept = points.unionByName(starts, allowMissingColumns=True)
    order = Window.partitionBy("lane").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = swept.withColumn("open", F.last("stack", ignorenulls=True).over(order)).filter("is_url = 1")
    fits = F.filter("open", lambda r: (F.col("key") < r["end"]) & F.startswith(F.col("path"), r["path"]))
    best = F.array_max(fits)
    out = swept.withColumn("best", best)
    return out.select(F.col("__id").alias("id"), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(otherwise)).alias("verdict"))
