"""The quality profile of each sequencing run, kept up to date as files of reads arrive.

    python -m jobs.quality_monitor --documents FOLDER --out FOLDER --checkpoint FOLDER [--config FILE]

A file stream takes what has arrived since the checkpoint and ends. Each of its batches is added up alone and written to
OUT/increments/batch=N, over whatever an interrupted try has left there. Counts of all increments together are OUT/profile
(qualities by position, by the quality before, by context), and what follows from them OUT/summary (reads are not counted
twice: bases, mean quality, error rate that the qualities claim, correlation of neighbours). Both are partitioned by source.
A rerun without new files leaves everything as it is.

OUT and the checkpoint belong together: neither may be deleted alone. A null source is a source of its own, and an empty one the same.
"""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlens.operators import bases
from readlens.plans import bridge
from readlens.session import ship
from readlens.table import counted

CONFIG = Path(__file__).with_suffix(".json")
COUNTS = "source string, axis string, value string, q int, n long"
log = logging.getLogger("jobs.quality_monitor")


def settings(path: str | Path = CONFIG) -> dict[str, Any]:
    """The configuration; an unknown key raises."""
    found = json.loads(Path(path).read_text())
    if unknown := set(found) - {"max_files_per_trigger", "flank"}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return found


def summary(profile: DataFrame) -> DataFrame:
    """(source, bases, mean_q, claimed_rate, lag_correlation), from the profile's counts alone."""
    n, q, before = F.col("n"), F.col("q").cast("double"), F.col("value").cast("double")
    at = profile.filter("axis = 'position'").groupBy("source").agg(
        F.sum(n).alias("bases"), (F.sum(n * q) / F.sum(n)).alias("mean_q"), (F.sum(n * F.pow(F.lit(10.0), -q / 10)) / F.sum(n)).alias("claimed_rate")
    )
    sums = {"m": F.lit(1.0), "x": before, "y": q, "xx": before * before, "yy": q * q, "xy": before * q}
    lag = profile.filter("axis = 'transition'").groupBy("source").agg(*(F.sum(n * v).alias(k) for k, v in sums.items()))
    spread = (F.col("m") * F.col("xx") - F.col("x") * F.col("x")) * (F.col("m") * F.col("yy") - F.col("y") * F.col("y"))
    r = F.when(spread > 0, (F.col("m") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(F.when(spread > 0, spread)))
    lag = lag.select(F.col("source").alias("s"), r.alias("lag_correlation"))
    return at.join(lag, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict[str, Any] | None = None) -> dict[str, DataFrame]:
    """Take what is new, wait until that is done, and return both tables as they now stand."""
    own = settings() if config is None else config
    shape = spark.read.parquet(documents).select("doc_id", "source", "text").schema
    arriving = spark.readStream.schema(shape).option("maxFilesPerTrigger", own["max_files_per_trigger"]).parquet(documents)
    flank = tuple(own["flank"])

    def add(batch: DataFrame, number: int) -> None:
        made = bases.profile_axes(bridge.cut(batch.withColumn("source", F.nullif("source", F.lit("")))), ("source",), flank)
        made.write.mode("overwrite").parquet(f"{out}/increments/batch={number}")
        log.info("wrote %s/increments/batch=%d", out, number)

    query = arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %s: %d new rows in %d batches", documents, sum(p["numInputRows"] for p in query.recentProgress), sum(p["numInputRows"] > 0 for p in query.recentProgress))

    whole = spark.read.schema(COUNTS).parquet(f"{out}/increments")
    found = {}
    for name, df in (("profile", counted(whole, ["source", "axis", "value", "q"], "n")), ("summary", None)):
        df = summary(found["profile"]) if df is None else df
        df.repartition("source").write.mode("overwrite").partitionBy("source").parquet(f"{out}/{name}")
        found[name] = spark.read.schema(df.schema).parquet(f"{out}/{name}")
        log.info("wrote %s/%s: %d rows", out, name, found[name].count())
    return found


def main(arguments: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quality_monitor", description=__doc__.split("\n")[0])
    p.add_argument("--documents", required=True, help="a folder that Parquet files arrive in, or a pattern of paths")
    p.add_argument("--out", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = ship(SparkSession.builder.appName("quality_monitor").getOrCreate())
    try:
        run(spark, a.documents, a.out, a.checkpoint, settings(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
