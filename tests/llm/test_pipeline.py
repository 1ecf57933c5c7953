"""The corpus pipeline: every stage on its own input, and the whole."""

import collections
import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from strata.llm import mixing
from strata.llm.shared import written
from tests.llm import brute
from tests.llm.test_llm_ops import P, edge_rows, DOC, tiktoken_encoding  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of each stage over sf0.001."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        done = written(stage(spark, docs, SF), "step")
        out.append((name, docs, done))
        docs = done
    return out


def test_columns_and_whole_rows(steps):
    for name, before, after in steps[:-1]:
        assert after.columns == before.columns, name
        assert not after.select("doc_id").subtract(before.select("doc_id")).count()


def test_quality_keeps_clean_documents(spark, steps):
    _, before, after = steps[0]
    failed = {r.doc_id for r in before.collect() if brute.quality(r.text)[5]}
    kept = {r.doc_id for r in after.collect()}
    assert not failed & kept
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()} - failed
    assert len(good & kept) >= 0.95 * len(good)


def test_one_of_each_group(steps):
    _, before, after = steps[1]
    groups = brute.jaccard([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted({c if n else i for i, n, c in groups})


def test_secrets_are_gone(steps):
    _, before, after = steps[2]
    texts = {r.doc_id: r for r in after.collect()}
    for r in before.collect():
        spans = brute.secrets(r.text)
        assert all(r.text[a:b] not in texts[r.doc_id].text for a, _, b in spans)
        assert spans or texts[r.doc_id].text == r.text or "[secret]" in texts[r.doc_id].text
    assert after.count() == before.count()


def test_mixture_keeps_all(steps):
    _, before, after = steps[3]
    assert not before.exceptAll(after).count() and not after.exceptAll(before).count()


def test_tokens(steps):
    _, before, after = steps[4]
    _, enc = tiktoken_encoding()
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edge_rows_pass(spark, tmp_path):
    docs = written(spark.createDataFrame(edge_rows(), DOC).withColumn("n_words", F.lit("x")), "edge-pipeline")
    spark.createDataFrame([(None, 0), (25, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = written(stage(spark, frame, str(tmp_path)), "edge-step")


def test_run(spark):
    df = corpus_pipeline.run(spark, SF)
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and df.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5


def test_run_keeps_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing.places, "__defaults__", tuple(1 if d == mixing.BLOCK_ROWS else d for d in mixing.places.__defaults__))
    small = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "64k"}
    old = {k: spark.conf.get(k) for k in small}
    try:  # many files and blocks, as a large corpus has
        for k, v in small.items():
            spark.conf.set(k, v)
        rows = [r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    left = collections.Counter(source[i] for i in rows)
    assert len(left) > 1 and len(set(rows)) == len(rows)
    here = collections.Counter()
    for n, i in enumerate(rows, 1):
        here[source[i]] += 1
        # equal weights: less than one block (here a row) from the share
        assert all(abs(here[s] - n / len(left)) < 1 for s in left), n
        if any(here[s] == left[s] for s in left):
            break
    assert n > len(left) * 4
    for s in left:  # a source's documents come in key order
        assert [i for i in rows if source[i] == s] == sorted(i for i in rows if source[i] == s)


def test_ids_travel_packed(steps, spark):
    """Joins, written rows and the sort of the last stage carry at most 2.2 bytes a token (4 before)."""
    placed = corpus_pipeline.placed_tokens(steps[-1][1])
    row = placed.agg(F.sum(F.octet_length("ids")).alias("bytes"), F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).first()
    assert row.bytes <= 2.2 * row.n + 64 * row.rows
    for r in corpus_pipeline.in_order(placed).collect():
        assert len(r.ids) == r.n_tokens and hashlib.sha256(brute.packed(r.ids)).hexdigest() == r.ids_sha256
