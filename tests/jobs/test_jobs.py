"""The jobs: two runs over growing input, reruns, partial runs, edge cases, and their queries against SQL."""

import json
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import overlap_calibration, quality_monitor, queries
from readlens.operators import bases, overlap
from readlens.plans import bridge

from ..conftest import ROOT

COLUMNS = "doc_id long, source string, text string, axis string"
ROWS = [
    (1, "a", "The quick brown fox jumps over the lazy dog. " * 7, "x"),
    (2, "a", "An orchard of apples and a garden of pears, " * 3, "x"),
    (3, "b", "Short.", None),
    (4, None, "A row without a source, which is long enough to be cut into reads that overlap. " * 2, "x"),
    (5, "", "An empty source counts as none.", "x"),
    (6, "b", None, "x"),
    (7, "c", "", "x"),
    (8, "c", "12 %% 中文", "x"),
    (2, "a", "An orchard of apples and a garden of pears, " * 3, "x"),
    (9, "b", "z" * 3000, "x"),
]


def rows(df):
    return sorted(map(str, (r.asDict() for r in df.collect())))


def put(spark, folder, part, name):
    """One more file in a folder."""
    spark.createDataFrame(part, COLUMNS).coalesce(1).write.parquet(f"{folder}-{name}")
    folder.mkdir(exist_ok=True)
    for file in (folder.parent / f"{folder.name}-{name}").glob("*.parquet"):
        shutil.copy(file, folder / f"{name}.parquet")


def near(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_monitor_takes_only_what_is_new(spark, tmp_path):
    docs = tmp_path / "docs"
    put(spark, docs, ROWS[:4], "one")
    run = lambda: quality_monitor.run(spark, str(docs), str(tmp_path / "out"), str(tmp_path / "mark"))
    first = rows(run()["profile"])
    increments = tmp_path / "out" / "increments"
    assert sorted(p.name for p in increments.iterdir()) == ["batch=0"]
    written = {p: p.stat().st_mtime_ns for p in increments.rglob("*.parquet")}
    put(spark, docs, ROWS[4:], "two")
    found = run()
    assert sorted(p.name for p in increments.iterdir()) == ["batch=0", "batch=1"]
    assert all(p.stat().st_mtime_ns == t for p, t in written.items()) and rows(found["profile"]) != first
    whole = spark.createDataFrame(ROWS, COLUMNS).withColumn("source", F.nullif("source", F.lit("")))
    wanted = bases.profile_axes(bridge.cut(whole), ("source",))
    assert rows(found["profile"]) == rows(wanted.select(found["profile"].columns))
    profile, summary = rows(found["profile"]), rows(found["summary"])
    again = run()
    assert (rows(again["profile"]), rows(again["summary"])) == (profile, summary)
    assert sorted(p.name for p in increments.iterdir()) == ["batch=0", "batch=1"]
    assert (tmp_path / "out" / "profile" / "source=a").is_dir()


def test_monitor_replaces_what_an_interrupted_batch_left(spark, tmp_path):
    """A batch whose increment is there, but which the checkpoint doesn't know of, is written over and not added."""
    docs = tmp_path / "docs"
    put(spark, docs, ROWS[:4], "one")
    left = spark.createDataFrame([("a", "position", "1", 2, 99)], quality_monitor.COUNTS)
    left.write.parquet(str(tmp_path / "out" / "increments" / "batch=0"))
    found = quality_monitor.run(spark, str(docs), str(tmp_path / "out"), str(tmp_path / "mark"))
    clean = quality_monitor.run(spark, str(docs), str(tmp_path / "other"), str(tmp_path / "mark2"))
    assert rows(found["profile"]) == rows(clean["profile"])


def test_monitor_files_in_turns_give_the_same(spark, tmp_path):
    docs = tmp_path / "docs"
    for i, r in enumerate(ROWS):
        put(spark, docs, [r], f"f{i}")
    each = quality_monitor.run(spark, str(docs), str(tmp_path / "each"), str(tmp_path / "m1"), {"max_files_per_trigger": 3, "flank": [1, 1]})
    once = quality_monitor.run(spark, str(docs), str(tmp_path / "once"), str(tmp_path / "m2"))
    assert len(list((tmp_path / "each" / "increments").iterdir())) == 4
    assert rows(each["profile"]) == rows(once["profile"])


def test_summary_counts_bases_once(spark):
    reads = [("a", [2, 12, 12, 37], "ACGT"), ("a", [37], "A"), ("b", [12, 12], "AC")]
    df = spark.createDataFrame([(i, 1, s, q, seq) for i, (s, q, seq) in enumerate(reads)], "read_id long, mate int, source string, q array<int>, seq string")
    out = {r.source: r for r in quality_monitor.summary(bases.profile_axes(df, ("source",))).collect()}
    q = [2, 12, 12, 37, 37]
    assert out["a"].bases == 5 and near(out["a"].mean_q, sum(q) / 5) and near(out["a"].claimed_rate, sum(10 ** (-x / 10) for x in q) / 5)
    x, y = [2, 12, 12], [12, 12, 37]
    mx, my = sum(x) / 3, sum(y) / 3
    r = sum((a - mx) * (b - my) for a, b in zip(x, y)) / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5
    assert near(out["a"].lag_correlation, r) and out["b"].bases == 2 and out["b"].lag_correlation is None


def test_calibration_from_known_differences(spark):
    """Two bases differ: one at qualities 10 and 20, one at 20 and 20; each difference is shared out as the claimed chances are."""
    r1 = "ACGTTGCAAGTCATGCCATTAGGCA"
    r2 = list(r1)
    r2[3], r2[8] = "A", "T"
    q1, q2 = [20] * 25, [20] * 25
    q1[3] = 10
    pair = [(1, r1, q1, "".join(r2)[::-1].translate(str.maketrans("ACGT", "TGCA")), q2[::-1], "s")]
    placed = overlap.placements(spark.createDataFrame(pair, "pair_id long, r1 string, q1 array<int>, r2 string, q2 array<int>, source string"))
    out = {(r.mate, r.q): r for r in overlap.calibration(placed.filter("status = 'placed'"), ("source",)).collect()}
    assert {k: r.bases for k, r in out.items()} == {(1, 10): 1, (1, 20): 24, (2, 20): 25}
    assert near(out[1, 10].errors, 0.1 / 0.11) and near(out[1, 20].errors, 0.5) and near(out[2, 20].errors, 0.01 / 0.11 + 0.5)


def test_calibration_reruns_and_partial_runs(spark, tmp_path):
    docs, out = str(tmp_path / "docs.parquet"), str(tmp_path / "out")
    spark.createDataFrame(ROWS, COLUMNS).write.parquet(docs)
    first = {k: rows(v) for k, v in overlap_calibration.run(spark, docs, out).items()}
    assert {k: rows(v) for k, v in overlap_calibration.run(spark, docs, out).items()} == first
    pairs = {r.source: r for r in spark.read.parquet(f"{out}/pairs").collect()}
    assert set(pairs) == {"a", "b", None} and pairs["a"].pairs >= pairs["a"].no_overlap + pairs["a"].indel
    spark.createDataFrame([(1, "a", ROWS[0][2][:120], None), (50, "b", ROWS[0][2], None)], COLUMNS).write.mode("overwrite").parquet(docs)
    part = overlap_calibration.run(spark, docs, out, sources=["a"])
    own, kept = part["pairs"].filter("source = 'a'"), part["pairs"].filter("source is null or source != 'a'")
    assert own.first().pairs < pairs["a"].pairs and {r.source: r.pairs for r in kept.collect()} == {s: pairs[s].pairs for s in ("b", None)}
    assert set(r.source for r in overlap_calibration.run(spark, docs, out)["pairs"].collect()) == {"a", "b"}


def test_empty_tables(spark, tmp_path):
    docs = tmp_path / "docs"
    put(spark, docs, [], "none")
    found = quality_monitor.run(spark, str(docs), str(tmp_path / "m"), str(tmp_path / "mark"))
    assert not found["profile"].count() and not found["summary"].count()
    both = overlap_calibration.run(spark, str(docs), str(tmp_path / "c"))
    assert not both["pairs"].count() and not both["calibration"].count()


def test_unknown_settings_raise(tmp_path):
    path = tmp_path / "own.json"
    path.write_text(json.dumps({"flanks": [1, 1]}))
    for job in (overlap_calibration, quality_monitor):
        assert job.settings()
        with pytest.raises(ValueError, match="unknown settings"):
            job.settings(path)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_equal_sql(spark, tmp_path, name):
    docs = [(i, s, t) for i, s, t, _ in ROWS[:8] + ROWS[9:]]
    spark.createDataFrame(docs, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    own = queries.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    theirs = con.sql(queries.ORACLE_SQL[name])
    assert sorted(own.columns) == sorted(theirs.columns)
    a = sorted(str([r[c] for c in sorted(own.columns)]) for r in own.collect())
    b = sorted(str([float(v) if type(v).__name__ == "Decimal" else v for v in (dict(zip(theirs.columns, r))[c] for c in sorted(theirs.columns))]) for r in theirs.fetchall())
    assert a == b


def test_command_lines(tmp_path):
    for job in ("overlap_calibration", "quality_monitor"):
        done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--help"], cwd=ROOT, capture_output=True, text=True)
        assert done.returncode == 0 and "--documents" in done.stdout
