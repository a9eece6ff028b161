"""How far the reported qualities of each sequencing run can be trusted, from where the mates of its pairs overlap.

    python -m jobs.overlap_calibration --documents DOCUMENTS --out FOLDER [--config FILE] [--sources A B ...]

Writes OUT/pairs (pairs of each source by the state of their overlap) and OUT/calibration (error rate and quality found for
each mate and reported quality), both partitioned by source. A run over all sources replaces both tables; one over some
sources replaces those sources' partitions and leaves the others. The same input gives the same tables.

A null source is a source of its own, and an empty one the same. Sources without a placed pair have a row in pairs and none in calibration.
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

from readlens.kernels.place import Rules
from readlens.operators import overlap
from readlens.plans import bridge
from readlens.session import Stages, ship

CONFIG = Path(__file__).with_suffix(".json")
TABLES = ("pairs", "calibration")
log = logging.getLogger("jobs.overlap_calibration")


def settings(path: str | Path = CONFIG) -> dict[str, Any]:
    """The configuration, whose keys are the rules of placing mates; an unknown one raises."""
    found = json.loads(Path(path).read_text())
    if unknown := set(found) - set(Rules.__dataclass_fields__):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return found


def _write(df: DataFrame, path: str, some: bool) -> None:
    """All partitions anew, or only those that df has."""
    # Few rows of each source, so one file a source.
    df.repartition("source").write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if some else "static").partitionBy("source").parquet(path)


def run(spark: SparkSession, documents: str, out: str, config: dict[str, Any] | None = None, sources: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Read documents, write both tables and return them as they now stand."""
    rules = Rules(**(settings() if config is None else config))
    docs = spark.read.parquet(documents).select("doc_id", F.nullif("source", F.lit("")).alias("source"), "text")
    if sources is not None:
        docs = docs.filter(F.col("source").isin(list(sources)))
    stages = Stages(spark, "overlap-calibration")
    placed = stages.write(overlap.placements(bridge.pairs(bridge.cut(bridge.spread(docs)), ("source",)), rules).drop("r2_rc"), "placed")
    log.info("read %s, %s: %d pairs", documents, "all sources" if sources is None else f"sources {sorted(sources)}", placed.count())
    made = {
        "pairs": overlap.agreement(placed, ("source",)),
        "calibration": overlap.calibration(placed.filter("status = 'placed'"), ("source",)),
    }
    found = {}
    for name in TABLES:
        _write(made[name], f"{out}/{name}", sources is not None)
        found[name] = spark.read.schema(made[name].schema).parquet(f"{out}/{name}")
        log.info("wrote %s/%s: %d rows", out, name, found[name].count())
    stages.drop(placed)
    return found


def main(arguments: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="overlap_calibration", description=__doc__.split("\n")[0])
    p.add_argument("--documents", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--config", default=str(CONFIG))
    p.add_argument("--sources", nargs="+")
    a = p.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = ship(SparkSession.builder.appName("overlap_calibration").getOrCreate())
    try:
        run(spark, a.documents, a.out, settings(a.config), a.sources)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
