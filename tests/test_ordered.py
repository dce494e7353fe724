import random
from collections import Counter

import numpy as np
import pytest

from hitweave.functions import columns as C
from hitweave.operators import fits
from hitweave.operators import ordered as O
from pyspark.sql import functions as F


@pytest.mark.parametrize("times", [
    [*range(400), 10**15],  # an outlier stretches the scale
    [*[5] * 150, *range(0, 10**9, 10**7), *range(500, 700)],  # equal times and a burst
])
def test_uneven_times_are_dealt_evenly_and_lag_is_global(spark, times):
    rows = spark.createDataFrame(list(enumerate(map(float, times))), "id long, t double")
    dealt = O.with_range(rows, "t", 20)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high")).orderBy("_range").collect()
    assert all(r.n <= 80 or r.low == r.high for r in sizes) and all(a.high < b.low for a, b in zip(sizes, sizes[1:]))
    order = [i for t, i in sorted((t, i) for i, t in enumerate(times))]
    found = {r.id: r.prev for r in O.lag_global(dealt, "t", ["t", "id"], {"prev": "id"}).collect()}
    assert found == {b: a for a, b in zip([None, *order], order)}


def extended(rows, bits):
    """``(k, i, raw, extended, late)`` by the rule, one reading after another."""
    state, out, period = {}, [], 1 << bits
    for k, i, raw in sorted(rows, key=lambda r: (r[0], r[1])):
        if k not in state:
            state[k] = (raw, 0)
            out.append((k, i, raw, raw, False))
            continue
        last, epoch = state[k]
        if (raw - last) % period > period // 2:
            out.append((k, i, raw, None if epoch == 0 else (epoch - 1) * period + raw, True))
        else:
            state[k] = (raw, epoch + (raw < last))
            out.append((k, i, raw, state[k][1] * period + raw, False))
    return Counter(out)


@pytest.mark.parametrize("bits,step,behind,seed", [(4, 2, 4, 1), (8, 32, 64, 2), (13, 4095, 4095, 3), (16, 30_000, 20_000, 4), (5, 32, 1, 5)])
@pytest.mark.parametrize("parts,adaptive", [("1", "true"), ("2", "false"), ("8", "true"), ("8", "false")])
def test_counters_with_late_readings(spark, bits, step, behind, seed, parts, adaptive):
    rng, period = random.Random(seed), 1 << bits
    rows, now = [], rng.randrange(period)
    for i in range(400):
        now += rng.randrange(step)
        key = 0 if i < 300 else i % 3
        rows.append((key, i, (now - (rng.randrange(behind) if rng.random() < 0.3 else 0)) % period))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(old, (parts, adaptive)):
            spark.conf.set(k, v)
        found = O.extended_counter(spark.createDataFrame(rows, "k int, id long, raw long").repartition(3), "id", "raw", bits, ["k"])
        assert found.rdd.getNumPartitions() in (1, int(parts)) and found.count() == len(rows)
        got = found.collect()
        assert Counter((r.k, r.id, r.raw, r.extended, r.late) for r in got) == extended(rows, bits)
        last = {}
        for r in sorted(got, key=lambda r: (r.k, r.id)):
            last[r.k] = last.get(r.k) if r.late else r.extended
            assert r.held == last[r.k]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(40))
def test_effect_of_readings_on_any_beginning(seed):
    rng, bits = random.Random(seed), 5
    values = [rng.randrange(32) for _ in range(rng.randrange(1, 8))]
    effect = O.CounterEffect(bits)
    effect.read(np.array(values))
    for begin in range(32):
        *_, state = O.counted(np.array(values), bits, (begin, 7))
        assert O.after_arcs(effect.arcs(), (begin, 7), None) == state


def test_counters_without_readings(spark):
    empty = O.extended_counter(spark.createDataFrame([], "k int, id long, raw long"), "id", "raw", 8, ["k"])
    assert empty.collect() == [] and empty.columns == ["k", "id", "raw", "extended", "late", "held"]
    rows = O.extended_counter(spark.createDataFrame([(1, 1, None), (1, 2, 300), (1, 3, None), (1, 4, 5)], "k int, id long, raw long"), "id", "raw", 8, ["k"])
    assert sorted((r.id, r.extended, r.late) for r in rows.collect()) == [(1, None, False), (2, 44, False), (3, None, False), (4, None, True)]


def test_rates_are_written_with_their_unit(spark):
    row = spark.range(1).select(*[C.rate_text(F.lit(x)).alias(f"a{i}") for i, x in enumerate((2.5, 999.6, 1500.0))], C.byte_rate_text(F.lit(2.25e9)).alias("b"), C.byte_rate_text(F.lit(12.0)).alias("c")).first()
    assert tuple(row) == ("2 /s", "1000 /s", "1.50 K/s", "2.25 GB/s", "12 B/s")


def test_peaks_take_the_middle_of_plateaus_and_nothing_before_the_skipped_bins():
    y = np.zeros(60)
    y[3], y[20:25], y[40] = 500, 200, 150
    assert fits.find_peaks(y, 100, 10, 30, 10) == [(22, 200.0), (40, 150.0)]
    y[9:12] = (300, 180, 0)  # falls from the skipped bins: no peak, no base
    assert fits.find_peaks(y, 100, 10, 30, 10) == [(22, 200.0), (40, 150.0)]
    assert fits.find_peaks(np.zeros(5), 1, 1, 1, 10) == []


def test_ranges_of_heavy_tails_and_bursts_hold_few_rows(spark):
    from pyspark.sql import functions as F

    from hitweave.operators.ordered import with_range

    rows = spark.range(0, 20_000, 1, 4).select(F.pow(F.lit(2.0), F.rand(3) * 40).alias("v"), "id")
    rows = rows.unionByName(spark.range(20_000, 24_000).select((F.lit(1e6) + F.rand(4)).alias("v"), "id")).unionByName(spark.range(24_000, 25_000).select(F.lit(7.5).alias("v"), "id"))
    found = with_range(rows, "v", 100).groupBy("_range").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).orderBy("_range").collect()
    assert sum(r.n for r in found) == 25_000
    assert all(a.high < b.low for a, b in zip(found, found[1:]))
    assert all(r.n <= 400 or r.low == r.high for r in found)
