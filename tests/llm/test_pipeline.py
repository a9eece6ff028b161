"""The pipeline against brute force on a small corpus, and its registration."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from readlens.llm import bpe, neardup, pii, queries, textvec, toxicity

from .test_texts import shingles_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [make(20) for _ in range(10)]
    rows, labels = [], []
    for k in range(700):
        text = make(rng.randint(20, 90))
        toxic = rng.random() < 0.2
        if toxic:
            text = " ".join(w for pair in zip(text.split(), [rng.choice(["moron", "idiot", "scum", "clown"]) if rng.random() < 0.1 else "" for _ in range(90)]) for w in pair if w) + " idiot moron"
        if k % 50 == 3:
            text += " " + rng.choice(items)
        if k % 40 == 5:
            text += f" write to me{k}@mail.example.com or 10.0.0.{k % 250} today"
        if k % 30 == 7 and rows:
            text = rows[rng.randrange(len(rows))][1] + (" end" if k % 60 == 7 else "")
        rows.append((k, text, "en", f"s{k % 3}", len(text)))
        labels.append((k, 1, int(any(w in text.split() for w in ("moron", "idiot", "scum", "clown")))))
    rows += [(900, None, None, None, None), (901, "", "en", "s0", 0)]
    out = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(str(out / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(out / "benchmark.parquet"))
    return str(out), {r[0]: r[1] for r in rows}, items


def test_pipeline_equals_brute_force(spark, folder):
    path, texts, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.score(docs, spark.read.parquet(f"{path}/labels.parquet"), queries.toxic_fold).collect() if r.predicted}
    assert 90 < len(toxic) < 200
    left = {k: t or "" for k, t in texts.items() if k not in toxic}
    sequences = {}
    for k, t in left.items():
        hashes, _, _, offsets, _, _ = textvec.words([t])
        sequences[k] = textvec.shingles(hashes, offsets)[0]
    root = {k: k for k in left}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(left)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if left[a] == left[b] or neardup.similarity(sequences[a], sequences[b], 0.8) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    left = {k: t for k, t in left.items() if find(k) == k}
    bench = [shingles_of(x) for x in items]
    left = {k: t for k, t in left.items() if not any(len(s & shingles_of(t)) >= 0.8 * len(s) for s in bench)}
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = {}
    for k, t in left.items():
        clean = pii.redacted(t, [])
        assert not re.search(r"@mail|10\.0\.0\.", clean)
        ids = library.encode_ordinary(clean)
        wanted[k] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, path).collect()}
    assert got == wanted and len(got) < len(texts) - len(toxic)


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).dtypes == docs.dtypes
    empty = docs.filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder[0]).count() == 0


def test_registration():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "byte_bpe"]
    assert "op9_url_filter" in __spark_entry__.oracle_sql() and corpus_pipeline.ORACLE_SQL is None


def test_url_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view pages as select * from '/root/testdata/sf0.001/pages.parquet'")
    theirs = sorted(map(str, con.sql(queries.ORACLE_SQL["op9_url_filter"]).select("page_id, host, path, rule, verdict").fetchall()))
    ours = sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in queries.op9_url_filter(spark, "/root/testdata/sf0.001").collect())
    assert ours == theirs
