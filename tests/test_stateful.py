"""Stateful streams against batch results, for several cuts into micro-batches, ends of runs, late hits and ties."""

import os
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitweave.operators.ordered import nearest
from hitweave.streaming import stateful as S

HITS = "run_number long, event_id long, module int, channel int, energy int, flags long, timestamp_ns double, asks boolean, end boolean"


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    S.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def hit_rows(seed, n=400, runs=2, disorder=40):
    """Hits of some runs in arrival order, at most ``disorder`` out of time, with ties, each run closed by an end mark."""
    rng, rows = random.Random(seed), []
    for run in range(runs):
        hits = [(run, run * n + i, rng.randrange(3), rng.randrange(4), rng.randrange(999), 0, float(rng.randrange(6000)), rng.random() < 0.4, False) for i in range(n)]
        rows += sorted(hits, key=lambda h: h[6] + rng.random() * disorder) + [(run, None, None, None, None, None, None, None, True)]
    return rows


def streamed(spark, folder, rows, cuts, make, name):
    size = -(-len(rows) // cuts)
    for k, at in enumerate(range(0, len(rows), size)):
        spark.createDataFrame(rows[at : at + size], HITS).coalesce(1).write.parquet(str(folder / "parts" / f"p{k:03d}"))
    (folder / "in").mkdir()
    for k, part in enumerate(sorted((folder / "parts").iterdir())):
        file = next(part.glob("*.parquet"))
        target = folder / "in" / f"{k:03d}.parquet"
        file.rename(target)

        os.utime(target, (1_000_000 + k, 1_000_000 + k))
    source = spark.readStream.schema(HITS).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    query = make(source).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert query.exception() is None
    return spark.table(name)


@pytest.mark.parametrize("cuts", [1, 7])
def test_sorted_stream_equals_a_sort(spark, tmp_path, cuts):
    rows = hit_rows(1)
    found = streamed(spark, tmp_path, rows, cuts, lambda s: S.time_sorted(s, 100.0, "run_number", end="end"), f"sorted{cuts}")
    order = Window.partitionBy("run_number").orderBy("timestamp_ns", "event_id")
    batch = spark.createDataFrame(rows, HITS).filter("NOT end").withColumn("late", F.lit(False)).withColumn("position", F.row_number().over(order).cast("long") - 1)
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, batch.select(found.columns).collect()))


@pytest.mark.parametrize("cuts", [1, 7])
def test_nearest_in_stream_equals_the_batch_join(spark, tmp_path, cuts):
    rows = hit_rows(2, runs=1)
    found = streamed(spark, tmp_path, rows, cuts, lambda s: S.nearest_in_stream(s, "asks", 50.0, 60.0, end="end"), f"near{cuts}")
    hits = spark.createDataFrame(rows, HITS).filter("NOT end")
    batch = nearest(hits.filter("asks"), hits.filter("NOT asks"), "timestamp_ns", "timestamp_ns", 50.0, ["event_id"])
    want = batch.select("event_id", "_near.event_id", (F.col("_near.timestamp_ns") - F.col("timestamp_ns")).alias("dt")).collect()
    assert sorted((r.event_id, r.near_event_id or -1, r.dt) for r in found.collect()) == sorted((a, b or -1, dt) for a, b, dt in want)


def played(step, rows, cuts):
    """The step played over micro-batches without Spark: all that comes out, and the most that was held."""
    frame = pd.DataFrame([r for r in rows if not r[-1]], columns=[c.split()[0] for c in HITS.split(", ")]).drop(columns=["run_number", "end"])
    held, mark, out, most = frame.iloc[:0], S.Held.fresh, [], 0
    size = -(-len(frame) // cuts)
    for at in range(0, len(frame), size):
        found, held, mark = step(held, mark, frame[at : at + size], at + size >= len(frame))
        out.append(found)
        most = max(most, len(held))
    return pd.concat([f for f in out if len(f)], ignore_index=True), most


@pytest.mark.parametrize("seed", range(4))
def test_any_cut_gives_the_same(seed):
    rows = hit_rows(seed, 2000, 1)
    for step in (lambda h, m, f, e: S.sort_step(h, m, f, e, "timestamp_ns", 100.0), lambda h, m, f, e: S.nearest_step(h, m, f, e, "timestamp_ns", "asks", 50.0, 110.0)):
        whole, _ = played(step, rows, 1)
        for cuts in (2, 7, 200):
            found, most = played(step, rows, cuts)
            assert found.astype(object).where(found.notna(), None).equals(whole.astype(object).where(whole.notna(), None))
            assert most <= 2000 // cuts + 2000 * 220 // 6000 + 60  # what is held does not grow with the run


def test_late_hits_come_out_marked_and_keep_all_columns():
    names = ["event_id", "module", "timestamp_ns"]
    first, held, mark = S.sort_step(pd.DataFrame(columns=names), S.Held.fresh, pd.DataFrame([(1, 0, 10.0), (2, 0, 500.0)], columns=names), False, "timestamp_ns", 100.0)
    assert first[["event_id", "late", "position"]].values.tolist() == [[1, False, 0]]
    out, held, mark = S.sort_step(held, mark, pd.DataFrame([(3, 7, 5.0), (4, 0, None)], columns=names), True, "timestamp_ns", 100.0)
    assert out[["event_id", "module", "late"]].values.tolist() == [[3, 7, True], [2, 0, False]] and not len(held)
    assert out["position"].isna().tolist() == [True, False]


def test_a_key_starts_anew_after_its_end(spark, tmp_path):
    rows = hit_rows(3, 33, 1) + [(0, 900 + i, 0, 0, 1, 2**62 + 1, float(i), False, False) for i in range(33)] + [(0, None, None, None, None, None, None, None, True)]
    found = streamed(spark, tmp_path, rows, 2, lambda s: S.time_sorted(s, 100.0, "run_number", end="end"), "anew").filter("event_id >= 900").orderBy("position")
    assert [tuple(r) for r in found.select("event_id", "late", "position", "flags").collect()] == [(900 + i, False, i, 2**62 + 1) for i in range(33)]
