import math

import numpy as np
import pytest
from helpers import hit_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from hitweave.functions import columns as C
from hitweave.operators import fits, waveforms
from hitweave.operators import histograms as H
from hitweave.plans.scalar_queries import check_offsets
from hitweave.sources import digitizer, recorded, synthetic
from hitweave.sources.msgpack import pack, unpack


def values(spark, xs):
    return spark.createDataFrame([(float(x),) for x in xs], "v double")


def test_histogram_edges(spark):
    rows = H.hist1d(values(spark, [-1, 0, 9.9, 10, 11, 5]), [], F.col("v"), 0.0, 10.0, 5).collect()
    assert {r.bin: r.counts for r in rows} == {-1: 1, 0: 1, 2: 1, 4: 1, 5: 2}


def test_second_axis_out_of_range_is_overflow(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (1.0, 5.0), (9.99, 3.99), (1.0, None)], "x double, y double")
    found = {r.bin: r.counts for r in H.hist2d(rows, [], F.col("x"), F.col("y"), (0.0, 10.0, 10), (0.0, 4.0, 4)).collect()}
    assert found == {11: 1, -1: 1, 39: 1}


def test_peak_ties_take_the_last_bin_and_no_background_is_infinite(spark):
    hist = spark.createDataFrame([(0, 3, 7), (0, 4, 7)], "k int, bin int, counts long")
    row = H.peaks(hist, ["k"], 0.0, 1.0, 20, reach=2).first()
    assert row.peak_bin == 4 and row.significance == math.inf and row.centroid == 4.0


def test_difference_at_the_upper_end_is_not_counted(spark):
    pairs = spark.createDataFrame([(-10.0,), (9.9,), (10.0,)], "dt double")
    assert H.dt_hist(pairs, [], -10.0, 10.0, 1.0).agg(F.sum("counts")).first()[0] == 2


def test_scalars(spark):
    row = values(spark, [0]).select(
        C.psd_ratio(F.lit(0), F.lit(0)).alias("psd"), C.psd_fraction(F.lit(5), F.lit(5)).alias("flat"), C.sign_extend(F.lit(0x3FFF)).alias("minus"),
        C.remap_flags(F.lit((1 << 15) | (1 << 2))).alias("flags"), C.pole_zero(F.lit(float("inf"))).alias("pz"), C.scaled_energy(F.lit(float("nan")), 1, 0).alias("bad"),
        C.snapped(F.lit(7.6), 0.0, 100.0, 5.0).alias("snap"), C.rate_text(F.lit(2.5e6)).alias("rate"),
        C.bits_mask(C.mask_bits(F.lit("0xA5"), 8)).alias("mask"), C.hardware_time(F.lit(1), F.lit(4), F.lit(512), 2.0).alias("t"),
    ).first()
    assert tuple(row) == (None, 0.0, -1, 0x11, 0.0, 0, 10.0, "2.50 M/s", "0xa5", (2**31 + 4) * 2.0 + 1.0)


@pytest.mark.parametrize("bad", [
    [(0, 0, None, None, 0.0), (0, 0, None, None, 1.0)], [(0, 0, 9, 9, 0.0)], [(0, 0, 0, 1, 0.0), (0, 1, 0, 0, 0.0)],
])
def test_bad_offset_forests_are_refused(bad):
    with pytest.raises(ValueError):
        check_offsets(bad)


def test_deep_forests_warn():
    chain = [(0, 0, None, None, 0.0)] + [(0, i, 0, i - 1, 1.0) for i in range(1, 7)] + [(1, 0, None, None, 0.0)]
    assert check_offsets(chain) == ["several roots", "deeper than 5"]


def test_waveform_functions(spark):
    pulse = [0] * 20 + [10, 40, 80, 100, 90, 60, 30] + [0] * 20
    rows = spark.createDataFrame([(pulse,), ([],), (None,)], "s array<int>")
    found = rows.select(
        waveforms.baseline(F.col("s"), 16).alias("b"), waveforms.extremum(F.col("s"), False, 16)["index"].alias("i"),
        waveforms.moving_average(4)(F.col("s")).alias("m"), waveforms.crossing(0.5, 1, False)(F.col("s")).alias("c"),
        waveforms.rising_edge(F.col("s")).alias("e"), waveforms.asserted_centre(F.col("s")).alias("a"),
    ).collect()
    assert found[0].b == 0 and found[0].i == 23 and found[0].e == 20 and found[0].a == 23 and found[0].c.valid and found[0].c.time == 22.0
    assert np.allclose(found[0].m, [np.mean(pulse[max(0, i - 3) : i + 1]) for i in range(len(pulse))])
    assert found[1].m is None and found[2].m is None


def test_trapezoid_of_a_step_is_flat(spark):
    step = [5] * 30 + [105] * 40
    out = spark.createDataFrame([(step,)], "s array<int>").select(waveforms.trapezoid(4, 3, 0.0)(F.col("s")).alias("t")).first().t
    assert out[29] == 0 and out[-1] == max(out) or out[40] > 0


def test_fit_finds_a_gaussian(spark):
    x = np.arange(100)
    counts = np.round(1000 * np.exp(-0.5 * ((x - 41) / 6) ** 2) + 20).astype(int)
    hist = spark.createDataFrame([(0, int(i), int(c)) for i, c in enumerate(counts)], "k int, bin int, counts long")
    row = fits.fit_peaks(hist, ["k"], 0.0, 1.0, 100).first()
    assert abs(row.mu - 41.5) < 0.1 and abs(row.sigma - 6) < 0.2
    assert fits.search_peaks(hist, ["k"], 100).first().position == 41


@settings(max_examples=50, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False) | st.text(max_size=8) | st.binary(max_size=8),
                    lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=4), c, max_size=3), max_leaves=8))
def test_msgpack_round_trip(value):
    assert unpack(pack(value)) == (value, len(pack(value)))


def test_recorded_files(spark, tmp_path):
    events = [[1, 2, 300, 150, 10.5, 1, [0, 0, 0, 0], None], [0, 3, 400, 200, 11.0, 0, [1, 2, 3, 4], None]]
    whole = recorded.write_run([(7, 0, 0, events), (7, 1, 0, events[:1])], b"RUNFILE1")
    (tmp_path / "a.bin").write_bytes(whole)
    (tmp_path / "b.bin").write_bytes(whole[:60])
    hits = recorded.read_hits(spark, str(tmp_path / "*.bin"), b"RUNFILE1")
    assert hits.count() == 3 and hits.agg(F.sum("energy")).first()[0] == 1000
    checked = recorded.validate(spark, str(tmp_path / "a.bin"), b"RUNFILE1").orderBy("block").collect()
    assert [(r.block, r.events, r.ok) for r in checked] == [(0, 2, True), (1, 1, True)]
    foot = recorded.footers(spark, str(tmp_path / "a.bin")).first()
    assert foot.ok and foot.complete and foot.events == 3 and int(foot.checksum, 16) == int(checked[-1].checksum, 16) ^ foot.bytes
    with pytest.raises(Exception):
        recorded.read_hits(spark, str(tmp_path / "b.bin"), b"RUNFILE1", "FAILFAST").count()


def test_digitizer_words(spark):
    content = bytes.fromhex("0102030405060708")
    row = spark.createDataFrame([(content, b"")], "c binary, e binary").select(
        digitizer.words(F.col("c"), 4, False).alias("le"), digitizer.words(F.col("c"), 8, True).alias("be"), digitizer.words(F.col("e"), 4, False).alias("none")).first()
    assert row.le == [0x04030201, 0x08070605] and row.be == [0x0102030405060708] and row.none == []


def test_synthetic_hits_are_reproducible(spark):
    a, b = (synthetic.hits(spark, 1000, partitions=p).agg(F.count("*"), F.min("timestamp_ns")).first() for p in (2, 2))
    assert a == b and a[0] == 1000


def test_streams(spark, tmp_path):
    from hitweave.streaming import streams

    hits = hit_rows(spark, [(0, 0, 10, 1000), (0, 0, 20, 5000), (1, 0, 30, 3000)])
    hits.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(hits.schema).parquet(str(tmp_path / "in"))
    query = streams.live_histogram(source, 0, 100, 10).writeStream.outputMode("complete").format("memory").queryName("live").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("live").agg(F.sum("counts")).first()[0] == 3
    keyed = source.withColumn("source_id", F.col("module").cast("long")).select("source_id", "event_id", "timestamp_ns")
    query = streams.time_sorted(keyed, 1000.0).writeStream.outputMode("append").format("memory").queryName("sorted").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.source_id, r.event_id) for r in spark.table("sorted").collect()] == [(0, 0)]
    messages = spark.createDataFrame([(1, 1, "data"), (1, 2, "data"), (1, 1, "end"), (1, 3, "heartbeat")], "run_number int, source_id int, kind string")
    assert tuple(streams.end_of_streams(messages).first()) == (1, 2, 1, False)


def test_entry_and_catalogue(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
