import json

import pytest
from helpers import hit_rows

from hitweave.operators import events as E
from hitweave.operators.histograms import hist1d
from hitweave.sources import settings as S
from hitweave.sources import sinks
from pyspark.sql import functions as F

#: Two detectors in an or, an energy gate against a veto, and a sum of both: hits every few microseconds.
BUILD = {
    "timing": {"coincidence_window_ns": 750.0, "slice_duration_ns": 4e6},
    "l1": {
        "definitions": [
            {"type": "channel", "name": "ring_start", "module": 5, "channel": 2}, {"type": "module", "name": "wall", "module": 6, "channels": 2},
            {"type": "or", "name": "either", "inputs": ["ring_start", "wall"]},
        ],
        "trigger": "either",
    },
    "l2": [
        {"type": "energy_gate", "name": "hard", "module": 5, "channel": 2, "min": 900, "max": 2000},
        {"type": "counter", "name": "walls", "tags": ["wall", "roof"]}, {"type": "flag", "name": "alone", "monitor": "walls", "operator": "==", "value": 0},
        {"Type": "Accept", "Name": "lonely", "Monitor": ["alone"], "Operator": "AND"}, {"type": "accept", "name": "any", "monitor": ["hard", "alone"], "operator": "OR"},
    ],
}
CHANNELS = [
    [{"Module": 5, "Channel": 2, "DetectorType": "ring", "Tags": ["ring"], "p1": 0.5}],
    [{"Module": 6, "Channel": c, "DetectorType": "bar", "Tags": ["wall"] if c < 2 else []} for c in range(3)],
]


def test_settings_build_events(spark, tmp_path):
    s = S.build_settings(json.dumps(BUILD))
    rows = [(6, 1, 40, 3_000), (6, 2, 31, 3_100), (5, 2, 1200, 20_000), (6, 0, 77, 19_300), (5, 2, 300, 50_000), (6, 0, 5, 80_000), (5, 2, 899, 80_740)]
    hits = hit_rows(spark, rows)
    built = E.nested_events(E.event_hits(E.build_events(E.anchors(hits, s.triggers, s.root, s.window_ns), s.window_ns), hits, s.window_ns))
    found = E.evaluate_filters(built, s.filters, S.channel_tags(json.dumps(CHANNELS))).orderBy("event_no").collect()
    assert [(r.event_no, r.walls, r.hard, r.accepted, r.keep) for r in found] == [
        (0, 1, False, [], False), (1, 1, True, ["any"], True), (2, 0, False, ["lonely", "any"], True), (3, 1, False, [], False)]
    kept = E.number_kept(E.evaluate_filters(built, s.filters, S.channel_tags(json.dumps(CHANNELS))))
    sinks.write_events(kept, str(tmp_path / "e"), ["walls"])
    out = spark.read.parquet(str(tmp_path / "e")).orderBy("event_no").collect()
    assert [(r.event_no, r.ch, r.rel_time, r.walls, r.multiplicity) for r in out] == [(0, [0, 2], [0.0, 700.0], 1, 2), (1, [2], [0.0], 0, 1)]


def test_filters_must_name_known_nodes(spark):
    doc = BUILD | {"l2": [*BUILD["l2"], {"type": "flag", "name": "lost", "monitor": "nobody", "operator": ">", "value": 1}]}
    with pytest.raises(ValueError, match="nobody"):
        S.build_settings(json.dumps(doc))
    with pytest.raises(ValueError, match="name"):
        S.build_settings(json.dumps(BUILD | {"l2": [{"type": "counter", "name": "2 walls", "tags": []}, *BUILD["l2"]]}))


def test_short_slices_are_refused():
    with pytest.raises(ValueError):
        S.build_settings(json.dumps(BUILD | {"timing": {"coincidence_window_ns": 10, "slice_duration_ns": 5}}))


def test_channels_and_offsets(spark):
    assert S.channel_table(spark, json.dumps(CHANNELS)).agg(F.sum("p1")).first()[0] == 3.5
    tree = {"entries": [{"module": 9, "channel": 4, "ref": None, "offset_ns": -1.5}, {"module": 2, "channel": 7, "ref": [9, 4], "offset_ns": 31}]}
    assert S.clock_offsets(json.dumps(tree)) == [(9, 4, None, None, -1.5), (2, 7, 9, 4, 31.0)]
    flat = S.flat_offsets({(0, 1): 5.0, (1, 0): 2.0}, (0, 0))
    assert S.clock_offsets(flat) == [(0, 0, None, None, 0.0), (0, 1, 0, 0, 5.0), (1, 0, 0, 0, 2.0)]
    with pytest.warns(UserWarning):
        assert len(S.clock_offsets(json.dumps({"ref_module": 0, "ref_channel": 0, "offsets": {"O_3": 1}}))) == 1
    assert [t.name for t in S.command_line_triggers(["0:1", "2:3"])] == ["0:1", "2:3", "any"]


def test_histogram_lists(spark):
    good = {"histograms": [
        {"name": "e", "type": "TH1D", "fill": "energy", "bins": 10, "min": 0, "max": 100, "channel": 1},
        {"name": "ec", "type": "TH2D", "x": "energy", "xbins": 2, "xmin": 0, "xmax": 100, "y": "channel", "ybins": 4, "ymin": 0, "ymax": 4, "energy_range": [10, 60]},
    ]}
    specs, errors = S.histogram_specs(json.dumps(good))
    assert not errors
    hits = hit_rows(spark, [(0, 1, 15, 1), (0, 2, 60, 2), (0, 1, 500, 3)])
    assert {(r.name, r.bin): r.counts for r in S.fill(hits, specs).collect()} == {("e", 1): 1, ("e", 10): 1, ("ec", 2): 1, ("ec", 5): 1}
    bad = {"histograms": [{"type": "TH1D", "fill": "x", "bins": 0}, {"name": "a", "type": "TH9"}, {**good["histograms"][0], "energy_range": [1, 2], "typo": 1}]}
    specs, errors = S.histogram_specs(json.dumps(bad))
    assert not specs and len(errors) == 5


def test_sinks(spark, tmp_path):
    hits = hit_rows(spark, [(0, 0, 5, 1), (0, 1, 15, 2), (1, 0, 15, 3)]).withColumn("run_number", F.lit(7))
    for _ in range(2):
        sinks.write_hits(hits, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).filter("run_number = 7").count() == 6
    row = sinks.histogram_rows(hist1d(hits, ["module"], F.col("energy"), 0.0, 100.0, 10), ["module"], 0.0, 10.0).orderBy("module").first()
    assert (row.centres, row.counts, row.entries, row.peak) == ([5.0, 15.0], [1, 1], 2, 15.0)
    lines = sinks.metric_lines(hits.groupBy("module").count(), "rate", ["module"], "count").orderBy("line").collect()
    assert [r.line for r in lines] == ["rate,module=0 count=2i", "rate,module=1 count=1i"]
