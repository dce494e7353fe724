"""Counters taken while a result is written."""

import pytest
from pyspark.sql import functions as F

from hitweave.operators.observed import Counters, kept_hits


def test_counters_equal_separate_counts_in_one_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id AS event_id", "int(id % 3) AS module", "int(id % 97) AS energy", "double(id * 1e6) AS timestamp_ns").write.parquet(str(tmp_path / "in"))
    hits, counters = spark.read.parquet(str(tmp_path / "in")), Counters()
    kept = kept_hits(hits, counters, F.lit(40), F.col("event_id") < 800, [0, 1, 7])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("CollectMetrics") == 3
    kept.write.parquet(str(tmp_path / "out"))
    inside = hits.filter("event_id < 800")
    assert counters.values() == {
        "read": {"rows": 1000, "outside_runs": 200, "source_0": 334, "source_1": 333, "source_7": 0},
        "running": {"rows": 800, "below_threshold": inside.filter("energy < 40").count()},
        "kept": {"rows": spark.read.parquet(str(tmp_path / "out")).count(), "energy": inside.filter("energy >= 40").agg(F.sum("energy")).first()[0],
                 "latest_ms": inside.filter("energy >= 40").agg(F.max("event_id")).first()[0]},
    }
    with pytest.raises(ValueError):
        counters.watch(hits, "read")


def test_counters_of_nothing(spark, tmp_path):
    counters = Counters()
    empty = spark.createDataFrame([], "event_id long, module int, energy int, timestamp_ns double")
    kept_hits(empty, counters, F.lit(1), F.lit(True), []).write.parquet(str(tmp_path / "out"))
    assert counters.values()["kept"] == {"rows": 0, "energy": None, "latest_ms": None}
    assert counters.table(empty).filter("value IS NULL").count() == 2
