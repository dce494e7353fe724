"""Stages and operators on columns that cannot be sorted or have dots in their names, and mixes of many sources."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hitweave.llm import fingerprints, mixing


@pytest.fixture(scope="module")
def docs(spark):
    words = "the of and house water stone with from over down".split()
    rows = [(i, " ".join(words[(i * 7 + k * (1 + i % 3)) % 10] for k in range(12 + i % 5)) + f" {i}", "en" if i % 4 else "de", f"src{i % 3}") for i in range(60)]
    rows += [rows[3], rows[3], (200, rows[4][1], "en", "src1"), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return frame.withColumns({"a.b": F.col("doc_id") + 1, "m": F.create_map(F.lit("z"), F.col("doc_id"), F.lit("a"), F.lit(1).cast("long")), "deep": F.array(F.create_map(F.lit(1), F.lit(2)))})


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_of_any_kind_and_name(spark, docs, tmp_path, stage):
    docs.write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    found = corpus_pipeline.STAGES[stage][1](spark, read, "")
    assert found.schema.names == read.schema.names
    kept = found.select("doc_id", "`a.b`", "m").collect()
    assert len(kept) > 10 and all(r["a.b"] == r.doc_id + 1 and r.m == {"z": r.doc_id, "a": 1} for r in kept if r.doc_id is not None)


def test_last_stage_and_fingerprints_take_them_too(spark, docs):
    assert corpus_pipeline.STAGES[4][1](spark, docs, "").count() == 64
    assert fingerprints.fingerprint_documents(docs).select("`a.b`", "fingerprint").count() == 64


def test_large_mixes_equal_small_ones(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 7) AS source")
    weights = {"s0": 6, "s1": 12, "s2": 18, "s3": 600, "s4": 6}
    listed = mixing.mix(docs, weights, 6).collect()
    assert Counter(listed) == Counter(mixing.mix(docs, weights, 6, listed=3).collect()) == Counter(mixing.mix(docs, weights, 6, max_period=10).collect())
    assert max(r.release for r in listed) < max(r.slot for r in listed) + 1 and all(r.release <= r.slot < r.deadline for r in listed)


def test_many_sources_and_large_weights(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "concat('s', id % 20000) AS source")
    found = mixing.mix(docs, {f"s{i}": 1 + i % 50 for i in range(20_000)}, block=1)
    assert found.agg(F.count("*"), F.count_distinct("slot"), F.count_if(F.expr("slot < release OR slot >= deadline"))).first() == (40_000, 40_000, 0)
    heavy = mixing.mix(docs.limit(100).withColumn("source", F.expr("if(doc_id % 2 = 0, 'a', 'b')")), {"a": 1_000_000, "b": 999_999})
    assert heavy.filter("slot < release OR slot >= deadline").count() == 0 and heavy.count() == 100
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s0": 0})
