"""Live histograms and run states over streams of messages, for several cuts, restarts, stale ends, bad lists and repeated micro-batches."""

import json
import os
from collections import Counter

import pytest

from hitweave.streaming.live_runs import LiveRuns

ROWS = "seq long, run_number long, source_id long, kind string, module int, channel int, energy int, energy_short int"
LIST = json.dumps({"histograms": [{"name": "e", "type": "TH1D", "x": "energy", "xbins": 10, "xmin": 0, "xmax": 100}, {"name": "c", "type": "TH1D", "x": "channel", "xbins": 4, "xmin": 0, "xmax": 4, "energy_range": [50, 99]}]})


def messages(*said):
    """Rows of ``(run, source, kind, energy)``."""
    return [(i, run, source, kind, 0, i % 4, energy, 0 if energy else None) for i, (run, source, kind, energy) in enumerate(said)]


TWO_RUNS = messages(
    (1, 7, "end", None), *[(1, s, "data", e) for s in (0, 1) for e in range(0, 100, 5)], (1, 0, "heartbeat", None), (1, 0, "end", None), (1, 2, "end", None),
    (2, 0, "start", None), *[(2, 0, "data", e) for e in range(0, 100, 20)], (1, 1, "end", None), (2, 1, "data", 33), (2, 0, "end", None),
)


def played(spark, folder, rows, cuts, live, name):
    size = -(-len(rows) // cuts)
    (folder / "in").mkdir()
    for k, at in enumerate(range(0, len(rows), size)):
        spark.createDataFrame(rows[at : at + size], ROWS).coalesce(1).write.parquet(str(folder / f"p{k}"))
        target = folder / "in" / f"{k:03d}.parquet"
        next((folder / f"p{k}").glob("*.parquet")).rename(target)
        os.utime(target, (1_000_000 + k, 1_000_000 + k))
    source = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    query = source.writeStream.foreachBatch(live.take).queryName(name).option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def counts(live, run):
    return {(r.name, r.bin): r.counts for r in live.histograms(run).collect()}


def expected(rows, run, since=-1):
    out = Counter()
    for seq, r, _, kind, _, channel, energy, _ in rows:
        if r == run and kind == "data" and seq > since:
            out["e", energy // 10] += 1
            if 50 <= energy <= 99:
                out["c", channel] += 1
    return dict(out)


@pytest.mark.parametrize("cuts", [1, 6])
def test_two_runs_for_any_cut(spark, tmp_path, cuts):
    live = LiveRuns(spark, lambda: LIST, str(tmp_path / "live"))
    played(spark, tmp_path, TWO_RUNS, cuts, live, f"runs{cuts}")
    assert counts(live, 1) == expected(TWO_RUNS, 1) and counts(live, 2) == expected(TWO_RUNS, 2)
    assert {tuple(r) for r in live.runs().collect()} == {(1, 2, 2, True), (2, 2, 1, False)}


def test_a_start_clears_its_run(spark, tmp_path):
    rows = messages(*[(1, 0, "data", 10)] * 4, (1, 0, "end", None), (1, 0, "start", None), *[(1, 0, "data", 70)] * 3)
    for name, cut in (("a", 9), ("b", 5), ("c", 6)):
        live = LiveRuns(spark, lambda: LIST, str(tmp_path / name))
        for k, part in enumerate((rows[:cut], rows[cut:])):
            live.take(spark.createDataFrame(part, ROWS), k)
        assert counts(live, 1) == expected(rows, 1, 5) and [tuple(r) for r in live.runs().collect()] == [(1, 1, 0, False)]


def test_lists_are_swapped_only_without_errors(spark, tmp_path):
    said = {"text": LIST}
    live = LiveRuns(spark, lambda: said["text"], str(tmp_path / "live"))
    part = spark.createDataFrame(messages(*[(1, 0, "data", 60)] * 5), ROWS)
    live.take(part, 0)
    said["text"] = '{"histograms": [{"name": "e", "type": "TH9"}]}'
    live.take(part, 1)
    assert len(live.errors) == 1 and counts(live, 1)["e", 6] == 10
    said["text"] = LIST.replace('"xmax": 4', '"xmax": 8')
    live.take(part, 2)
    assert live.errors == [] and counts(live, 1)["e", 6] == 15  # unchanged, goes on
    assert sum(n for (name, _), n in counts(live, 1).items() if name == "c") == 5  # changed, began anew
    said["text"] = '{"histograms": [{"name": "t", "type": "TH1D", "x": "dt1", "xbins": 1, "xmin": 0, "xmax": 1}]}'
    live.take(part, 3)
    assert len(live.errors) == 1 and counts(live, 1)["e", 6] == 20


def test_a_micro_batch_played_again_counts_once(spark, tmp_path):
    live = LiveRuns(spark, lambda: LIST, str(tmp_path / "live"))
    parts = [spark.createDataFrame(TWO_RUNS[a : a + 20], ROWS) for a in range(0, len(TWO_RUNS), 20)]
    for k, part in enumerate(parts):
        live.take(part, k)
        live.take(part, k)
    assert counts(live, 1) == expected(TWO_RUNS, 1)
    assert live._table("counts", "run_number long", None).count() == 0
