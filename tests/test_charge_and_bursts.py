"""Registered queries against their SQL on tables that the given ones do not hold: hits without charge, hits in bursts."""

import datetime
import random
from collections import Counter

import pytest

from hitweave import catalogue

KINDS = ("click", "view", "purchase", "signup", "error")


def write_events(folder, rows):
    """``events`` of ``(seconds, user_id, event_type, value)`` as a table of ``folder``."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    start = datetime.datetime(2024, 1, 1)
    pq.write_table(pa.table({
        "event_id": pa.array(range(len(rows)), pa.int64()), "ts": pa.array([start + datetime.timedelta(seconds=r[0]) for r in rows], pa.timestamp("us")),
        "user_id": pa.array([r[1] for r in rows], pa.int64()), "event_type": [r[2] for r in rows], "value": pa.array([r[3] for r in rows], pa.float64()),
        "props": [f'{{"k": {i % 100}}}' for i in range(len(rows))],
    }), f"{folder}/events.parquet")
    return str(folder)


def same_as_sql(spark, folder, name):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    found = catalogue.QUERIES[name](spark, folder)
    expected = db.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(found.columns)
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter(expected.fetchall())


@pytest.mark.parametrize("name", ["hist1d_psd", "hist_dispatch"])
def test_hits_without_charge_have_no_pulse_shape(spark, tmp_path, name):
    rng = random.Random(1)
    rows = [(i, rng.randrange(8), rng.choice(KINDS), rng.choice([0.0, 0.001, 0.5, 700.0, rng.random() * 90])) for i in range(200)]
    same_as_sql(spark, write_events(tmp_path, rows), name)


def long_event(rng, n, step):
    """Hits ``step`` seconds apart on average, many at one time, so that they make one event or few; then two lone events."""
    rows, t = [], 100.0
    for _ in range(n):
        t += rng.choice([0, 0, rng.random() * 4 * step])
        rows.append((round(t, 3), rng.randrange(8), rng.choice(KINDS), round(rng.random() * 400, 2)))
    far = rows[-1][0] + 1000
    return rows + [(far, 1, "click", 120.0), (far + 50, 2, "view", 5.0), (far + 1000, 1, "click", 120.0), (far + 1050.001, 2, "view", 5.0), (far + 1000, 1, "click", 120.0)]


@pytest.mark.parametrize("name", ["event_with_ac", "l2_ac_veto", "module_correlation", "pipeline_counters", "l2_counter_flag_accept", "l2_energy_gate", "l2_min_hits", "l2_kept_events"])
def test_long_events_are_summed_without_lists_of_hits(spark, tmp_path, name):
    folder = write_events(tmp_path, long_event(random.Random(2), 600, 9))
    assert "collect_list" not in catalogue.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    same_as_sql(spark, folder, name)


def test_long_events_are_joined_from_pieces(spark, tmp_path, monkeypatch):
    from hitweave.operators import events

    kept = []
    monkeypatch.setattr(events, "durable", lambda rows, real=events.durable: kept.append(real(rows)) or kept[-1])
    folder = write_events(tmp_path, long_event(random.Random(3), 50_000, 1))
    same_as_sql(spark, folder, "built_event_arrays")
    sizes = [(r.event_no, r.n) for p in kept if "_hits" in p.columns for r in p.selectExpr("event_no", "size(_hits) AS n").collect()]
    assert sum(n > 10_000 for _, n in sizes) > 1 and max(n for _, n in sizes) < 40_000
