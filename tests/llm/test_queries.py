"""The registered queries of the subpackage on the smallest tables, and the pipeline."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_every_operator_is_registered():
    from tracewell.llm.queries import QUERIES

    assert sorted(k.split("_")[0] for k in QUERIES) == sorted([f"op{n}" for n in range(1, 11)] + ["pipeline"])


def test_url_query_against_sql(spark):
    from tracewell.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    res = con.execute(ORACLES["op1_url_filter"])
    names = [d[0] for d in res.description]
    assert sorted(map(repr, res.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in QUERIES["op1_url_filter"](spark, SF).collect())


def test_one_row_for_each_document(spark):
    from tracewell.llm.queries import QUERIES

    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op2_weak_pii", "op4_mjpeg_media", "op5_fm_toxicity", "op7_tree_bpe", "op8_qda_quality", "op9_simhash_dedup", "op10_cnn_langid"):
        assert QUERIES[name](spark, SF).count() == n, name


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    from tracewell.llm import simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_duplicates", "personal_data", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        if name == "near_duplicates":
            groups = simhash.near_duplicates(docs).select("component_id").distinct().count()
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        if name != "packing":
            assert docs.columns == columns and docs.count() <= before
            before = docs.count()
        if name == "near_duplicates":
            assert before == groups
        if name == "personal_data":
            assert docs.where(F.col("text").rlike(r"[a-z]@[a-z0-9]+\.[a-z]")).isEmpty() and docs.where("n_chars <> char_length(text)").isEmpty()
    assert docs.select("doc_id").distinct().count() == before
