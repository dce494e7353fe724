import struct
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from helpers import hit_rows

from hitweave.operators import fits, ledger
from hitweave.plans import run_queries
from hitweave.sources import recorded, sinks
from hitweave.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    for t in ("events", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(run_queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, duck, name):
    found = run_queries.QUERIES[name](spark, SF)
    expected = duck.execute(run_queries.ORACLE_SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(found.columns)
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter(expected.fetchall())


def test_messages_outside_a_run_change_nothing(spark):
    log = [(1, 0, 0, "stats", 5), (1, 1, 1000, "start", None), (1, 2, 1500, "error", None), (1, 3, 4000, "end", 9), (1, 4, 5000, "note", None), (1, 5, 6000, "end", 7),
           (2, 0, 10, "start", None), (2, 1, 20, "stats", 3), (3, 0, 0, "note", None)]
    found = {r.run_number: tuple(r)[1:] for r in ledger.run_documents(spark.createDataFrame(log, "run_number long, seq long, time_ms long, kind string, value long")).collect()}
    assert found == {1: (1000, 4000, 3, "completed", 9, 1, 0), 2: (10, None, None, "running", 3, 0, 0)}


def test_saving_a_new_document_starts_at_version_one(spark):
    schema = "name string, version int, is_current boolean"
    found = ledger.saved(spark.createDataFrame([("a", 1, True)], schema), spark.createDataFrame([("a",), ("b",)], "name string"), ["name"])
    assert {tuple(r) for r in found.collect()} == {("a", 1, False), ("a", 2, True), ("b", 1, True)}


def test_flat_records_read_back(spark):
    rows = hit_rows(spark, [(1, 2, 65535, 1.5), (255, 0, 0, 1e15)])
    found = sorted(bytes(r.record) for r in sinks.flat_records(rows, ["event_id"]).collect())
    expected = sorted(struct.pack("<BBHHQd", *v) for v in [(1, 2, 65535, 32767, 0, 1.5), (255, 0, 0, 0, 0, 1e15)])
    assert found == expected and {len(f) for f in found} == {22}


def test_scan_finds_the_strongest_peak_and_skips_thin_channels(spark):
    rows = [(0, b, int(1 + 400 * np.exp(-0.5 * ((b - 30) / 4) ** 2) + 200 * np.exp(-0.5 * ((b - 300) / 4) ** 2))) for b in range(400)] + [(1, 20, 99)]
    found = {r.k: tuple(r)[2:] for r in fits.scan_channels(spark.createDataFrame(rows, "k int, bin int, counts long"), ["k"], 65536).collect()}
    assert found == {0: (30, 0, 80), 1: (None, None, None)}


def test_gaussian_on_a_constant(spark):
    x = np.arange(400)
    y = np.round(20 + 900 * np.exp(-0.5 * ((x - 210.3) / 7.5) ** 2)).astype(int)
    rows = [(0, int(b), int(c)) for b, c in zip(x, y)] + [(1, 5, 3)]
    found = {r.k: r for r in fits.fit_regions(spark.createDataFrame(rows, "k int, bin int, counts long"), ["k"], 150, 260).collect()}
    fit = found[0]
    assert fit.status == "ok" and abs(fit.mu - 210.3) < 0.05 and abs(fit.sigma - 7.5) < 0.05 and abs(fit.ground - 20) < 0.5 and fit.chi2_ndf < 0.1
    assert found[1].status == "too few counts" and found[1].mu is None
    with pytest.raises(ValueError):
        fits.fit_regions(spark.createDataFrame(rows, "k int, bin int, counts long"), ["k"], 5, 5)


MAGIC = b"TESTRUN1"


def recording(cut: int = 0):
    batches = [(0, n, 0, [[0, 1, 100 + n, 50, float(10 * n + i), 0, [0, 0, 0, 0], None] for i in range(3)]) for n in range(4)]
    whole = recorded.write_run(batches, MAGIC, {"version": 3, "run": 7})
    return whole[: len(whole) - recorded.FOOTER - cut] if cut else whole


def test_cut_files_are_recovered_and_replayed(spark, tmp_path):
    (tmp_path / "whole.dat").write_bytes(recording())
    (tmp_path / "cut.dat").write_bytes(recording(cut=5))
    (tmp_path / "other.dat").write_bytes(b"no recording")
    found = {r.file.rsplit("/", 1)[1]: r for r in recorded.recover(spark, str(tmp_path), MAGIC).collect()}
    assert {k: (r.blocks, r.events) for k, r in found.items()} == {"whole.dat": (4, 12), "cut.dat": (3, 9)}
    assert bytes(found["whole.dat"].content) == recording()
    again = tmp_path / "again"
    again.mkdir()
    (again / "cut.dat").write_bytes(bytes(found["cut.dat"].content))
    foot = recorded.footers(spark, str(again)).first()
    assert (foot.ok, foot.events, foot.complete) == (True, 9, True)
    heads = {r.file.rsplit("/", 1)[1]: r.header for r in recorded.headers(spark, str(tmp_path), MAGIC).collect()}
    assert heads["other.dat"] is None and '"run": 7' in heads["cut.dat"]
    query = recorded.replay(spark, str(again), MAGIC).writeStream.format("memory").queryName("replayed").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("replayed").count() == 9


def test_every_hit_is_in_one_core_and_context_reaches_back():
    rng = np.random.default_rng(3)
    times = np.sort(rng.uniform(0, 10_000, 500)) + rng.uniform(0, 50, 500)  # at most 50 out of order
    hits = pd.DataFrame({"event_id": np.arange(500), "timestamp_ns": times, "late": False})
    held, start, core, chunks = hits[:0], float("-inf"), [], []
    for at in range(0, 500, 60):
        chunk, held, start = streams.next_chunk(pd.concat([held, hits[at : at + 60]]), start, 100.0, 300.0, at + 60 >= 500)
        if chunk is not None:
            core += list(chunk[chunk["core"]]["event_id"])
            chunks.append(chunk)
    assert sorted(core) == list(range(500)) and len(chunks) > 3
    for chunk in chunks[1:]:
        begin = chunk["core_start"].iloc[0]
        assert set(hits[hits["timestamp_ns"].between(begin - 300, begin)]["event_id"]) <= set(chunk["event_id"])
    narrow = hits[:3].assign(timestamp_ns=[1.0, 2.0, 3.0])
    assert streams.next_chunk(narrow, float("-inf"), 100.0, 0.0, False)[0] is None
    assert streams.next_chunk(hits[:0], 5.0, 1.0, 1.0, True) [0] is None


def test_chunks_of_a_stream_flush_at_the_end(spark, tmp_path):
    schema = "source_id long, event_id long, timestamp_ns double, end boolean"
    parts = [[(1, i, float(10 * i), False) for i in range(0, 30)], [(1, i, float(10 * i), False) for i in range(30, 60)] + [(1, 99, 5.0, False)], [(1, -1, 0.0, True)]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streams.safe_chunks(source, 100.0, 50.0).writeStream.format("memory").queryName("chunks").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    rows = spark.table("chunks").collect()
    assert sorted(r.event_id for r in rows if r.core) == list(range(60))
    assert [r.event_id for r in rows if r.late] == [99] and {r.chunk for r in rows} == {0, 1, 2}
