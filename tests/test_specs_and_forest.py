"""Histogram lists of both scopes and forests of offsets."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hitweave.operators import forest
from hitweave.sources import hist_specs as H

GOOD = {"name": "a", "type": "TH1D", "x": "dt1", "xbins": 4, "xmin": -10, "xmax": 10}


def errors(*nodes):
    return H.compile_list(json.dumps({"histograms": list(nodes)}))[1]


@pytest.mark.parametrize("change,message", [
    ({"name": ""}, "missing name"), ({"name": "a/b"}, "slash"), ({"type": "TH3D"}, "unknown type"), ({"x": "thgem1_energy_range"}, "unknown variable"), ({"x": None}, "missing x"), ({"x": 5}, "unknown variable"),
    ({"xbins": 0}, "above 0"), ({"xbins": "4"}, "must be a number"), ({"xmin": 10}, "below xmax"), ({"xmax": None}, "xmax is missing"), ({"colour": 1}, "unknown key colour"), ({"title": 1}, "title must be text"),
    ({"channel": 1}, "mixed scopes"), ({"gamma_energy_range": [5, 1]}, "is empty"), ({"gamma_energy_range": [1]}, "two numbers"), ({"gamma_energy_range": [0, 1], "thgem1_energy_range": [0, 1]}, "more than one cut"),
    ({"type": "TH2D"}, "missing y"), ({"type": "TH2D", "y": "energy", "ybins": 2, "ymin": 0, "ymax": 1}, "mixed scopes"),
])
def test_every_error_of_a_list_is_told(change, message):
    found = errors(GOOD | change, GOOD | {"name": "b", "xbins": -1})
    assert any(message in e for e in found) and any(e.startswith("b:") for e in found)


def test_lists_that_are_none():
    assert errors(GOOD) == [] and errors(GOOD, GOOD) == ["a: doubled name"] and errors(3) == ["histograms[0]: not an object"]
    assert "malformed" in H.compile_list("{")[1][0] and H.compile_list("[]")[1] == ["no list of histograms"]


def test_coincidences_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, 0, rng.randrange(5), rng.randrange(1, 99), 5, float(rng.randrange(900)), 0) for i in range(300)] + [(900, 0, 0, 1, 1, None, 0)]
    hits = spark.createDataFrame(rows, "event_id long, module int, channel int, energy int, energy_short int, timestamp_ns double, flags long")

    def near(t, channel):
        found = [(abs(r[5] - t), r[5], r[0], r) for r in rows if r[2] == channel and r[5] is not None and abs(r[5] - t) <= 7]
        return min(found)[3] if found else None

    want = Counter()
    for r in rows:
        if r[2] == 3 and r[5] is not None:
            a, b = near(r[5], 1), near(r[5], 2)
            want[(r[0], r[3], *((a[5] - r[5], a[3]) if a else (None, None)), *((b[5] - r[5], b[3]) if b else (None, None)))] += 1
    assert Counter(map(tuple, H.coincidences(hits, 3, (1, 2), 7.0).collect())) == want
    specs, _ = H.compile_list(json.dumps({"histograms": [GOOD, {"name": "c", "type": "TH1D", "fill": "channel", "bins": 5, "min": 0, "max": 5}]}))
    found = {(r.name, r.bin): r.counts for r in H.fill(hits, specs, 3, (1, 2), 7.0).collect()}
    assert sum(n for (name, _), n in found.items() if name == "c") == 301
    assert sum(n for (name, _), n in found.items() if name == "a") == sum(w[2] is not None for w in want)


def test_hits_are_scanned_once_a_scope(spark, tmp_path):
    spark.range(10).selectExpr("id AS event_id", "0 AS module", "int(id % 3) AS channel", "int(id) AS energy", "1 AS energy_short", "double(id) AS timestamp_ns").write.parquet(str(tmp_path / "h"))
    specs, _ = H.compile_list(json.dumps({"histograms": [GOOD | {"name": f"n{i}"} for i in range(4)] + [GOOD | {"name": f"e{i}", "x": "energy"} for i in range(4)]}))
    plan = H.fill(spark.read.parquet(str(tmp_path / "h")), specs, 0, (1, 2), 2.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2


def brute(entries):
    """``root, offset, depth, fault`` by walking up from each node."""
    times, of = Counter(n for n, *_ in entries), {n: (p, o) for n, p, o in entries}

    def bad(n):
        return "double" if times[n] > 1 else "dangling" if of[n][0] is not None and of[n][0] not in of else None

    out = {}
    for start in of:
        at, total, steps, seen = start, of[start][1], 0, set()
        while bad(at) is None and of[at][0] is not None and at not in seen:
            seen.add(at)
            at, steps = of[at][0], steps + 1
            total += of[at][1]
        fault = bad(at) and (bad(at) if at == start else "above") or ("cycle" if of[at][0] is not None else None)
        out[start] = (None, None, None, fault) if fault else (at, total, steps, None)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_forests_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    entries = [(i, rng.choice([None, *[rng.randrange(max(1, i))] * 6, rng.randrange(70), 900 + i]), rng.randrange(100) * 0.25) for i in range(60)] + [(5, 4, 1.0), (5, 4, 1.0)]
    found = forest.resolve(spark.createDataFrame(entries, "node long, parent long, ns double"), "node", "parent", "ns").collect()
    assert {r.node: tuple(r)[1:] for r in found} == brute(entries) and len(found) == 60


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(forest, "durable", lambda rows, f=forest.durable: rounds.append(1) or f(rows))
    chain = spark.range(10_000).selectExpr("struct(int(id) AS module, 0 AS channel) AS node", "if(id = 0, null, struct(int(id - 1) AS module, 0 AS channel)) AS parent", "0.5D AS ns")
    found = forest.resolve(chain, "node", "parent", "ns")
    last = found.orderBy(F.desc("node")).first()
    assert (last.offset, last.depth, last.root.module, last.fault) == (5000.0, 9999, 0, None) and len(rounds) <= 16
    assert {tuple(r) for r in forest.warnings(found).collect()} == {("deep", 9994)}
    assert forest.against_one(found).filter("ref.module = 0").count() == 10_000


def test_forests_without_entries(spark):
    empty = forest.resolve(spark.createDataFrame([], "node long, parent long, ns double"), "node", "parent", "ns")
    assert empty.collect() == [] and forest.warnings(empty).collect() == []
    circle = forest.resolve(spark.createDataFrame([(1, 2, 0.0), (2, 1, 0.0), (None, 1, 0.0)], "node long, parent long, ns double"), "node", "parent", "ns")
    assert {(r.node, r.fault) for r in circle.collect()} == {(1, "cycle"), (2, "cycle")}
