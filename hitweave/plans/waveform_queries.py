"""Waveforms, fits and peak searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import fits
from ..operators import waveforms as V
from ..operators.histograms import hist1d
from ..sources.hits import HITS_SQL, WAVEFORMS_SQL, hits, waveforms



def waveform_baseline(spark, d):
    return waveforms(spark, d).select("vec_id", F.round(V.baseline(F.col("samples"), 16), 6).alias("baseline"))


def waveform_peak(spark, d):
    low, high = V.extremum(F.col("samples"), True, 16), V.extremum(F.col("samples"), False, 16)
    return waveforms(spark, d).select("vec_id", low["value"].alias("low"), low["index"].alias("low_at"), high["value"].alias("high"), high["index"].alias("high_at"))


def waveform_charge(spark, d):
    peak = V.extremum(F.col("samples"), False)["index"]
    return waveforms(spark, d).select("vec_id", F.round(V.gated_charge(F.col("samples"), peak - 4, 12, V.baseline(F.col("samples"), 8)), 6).alias("charge"))


def waveform_stats(spark, d):
    per = waveforms(spark, d).select("channel", (V.extremum(F.col("samples"), False)["value"] - V.extremum(F.col("samples"), True)["value"]).alias("amplitude"), F.size(F.col("samples")).alias("n"))
    return per.groupBy("channel").agg(F.count("*").alias("traces"), F.sum("n").alias("samples"), F.min("amplitude").alias("least"), F.max("amplitude").alias("most"), F.round(F.avg("amplitude"), 6).alias("mean"))


def waveform_explode(spark, d):
    return V.exploded(waveforms(spark, d).select("vec_id", "samples", "ns_per_sample"))


def waveform_explode_all(spark, d):
    """Samples of the waveforms of all channels."""
    return V.exploded(waveforms(spark, d).select("vec_id", "samples", "ns_per_sample"))


def moving_average(spark, d):
    smooth = waveforms(spark, d).select("vec_id", V.moving_average(5)(F.col("samples")).alias("m"))
    return smooth.select("vec_id", F.posexplode("m").alias("i", "v")).select("vec_id", "i", F.round("v", 6).alias("v"))


def trapezoid(spark, d):
    rows = waveforms(spark, d).select("vec_id", V.trapezoid(4, 2, 3.0)(F.col("samples")).alias("t"))
    return rows.select("vec_id", F.posexplode("t").alias("i", "v")).select("vec_id", "i", F.round("v", 3).alias("v"))


def trapezoid_energy(spark, d):
    rows = waveforms(spark, d).select("vec_id", V.trapezoid(4, 2, 3.0)(F.col("samples")).alias("t"))
    return rows.select("vec_id", F.round(V.trapezoid_energy(20, 4, 2)(F.col("t")), 3).alias("energy"))


def cfd_time(spark, d):
    found = waveforms(spark, d).select("vec_id", V.crossing(0.5, 3, False)(F.col("samples")).alias("c"))
    return found.select("vec_id", F.round("c.time", 6).alias("time"), "c.valid")


def probe_edges(spark, d):
    on = F.transform(F.col("samples"), lambda x: (x > 1000).cast("int"))
    return waveforms(spark, d).select("vec_id", V.rising_edge(on).alias("edge"), V.asserted_centre(on).alias("centre"))


def deinterleaved(spark, d):
    a, b = V.deinterleave(F.col("samples"), False), V.deinterleave(F.col("samples"), True)
    return waveforms(spark, d).select("vec_id", V.total(a).alias("even_sum"), V.total(b).alias("odd_sum"))


def lanes(spark, d):
    words = F.transform(F.col("samples"), lambda x: (x.cast("long") + 32768) * 65536 + (x.cast("long") + 32768))
    return waveforms(spark, d).select("vec_id", V.total(V.lane(words, 0)).alias("lane0"), V.total(V.lane(words, 1)).alias("lane1"))


def pole_zero(spark, d):
    tau = F.when(F.col("event_id") % 10 == 0, F.lit(0.0)).otherwise((F.col("event_id") % 100).cast("double"))
    return hits(spark, d).select("event_id", F.round(C.pole_zero(tau), 6).alias("multiplier"))


def energy_scaling(spark, d):
    return hits(spark, d).select("event_id", C.scaled_energy(F.col("energy").cast("double"), 1.75, -500.0).alias("scaled"))


def gaussian_fit(spark, d):
    peak = hits(spark, d).withColumn("v", (500 + (F.col("energy") % 97) + (F.col("energy_short") % 89) + (F.col("event_id") % 101)).cast("double"))
    return fits.fit_peaks(hist1d(peak, ["module"], F.col("v"), 480.0, 800.0, 64), ["module"], 480.0, 5.0, 64)


def peak_search(spark, d):
    return fits.search_peaks(hist1d(hits(spark, d), ["module"], F.col("energy"), 0.0, 50000.0, 100), ["module"], 100, height=10, distance=5, prominence=5)


QUERIES = {f.__name__: f for f in (
    waveform_baseline, waveform_peak, waveform_charge, waveform_stats, waveform_explode, waveform_explode_all, moving_average, trapezoid, trapezoid_energy, cfd_time,
    probe_edges, deinterleaved, lanes, pole_zero, energy_scaling, gaussian_fit, peak_search,
)}

LONG = f"""{WAVEFORMS_SQL},
x AS (SELECT vec_id, channel, ns_per_sample, CAST(generate_subscripts(samples, 1) - 1 AS INTEGER) AS i, unnest(samples) AS v, len(samples) AS n FROM waveforms)"""
TRAP = f"""{LONG},
f AS (SELECT vec_id, i, v, first_value(v) OVER w AS v0, lag(v, 4) OVER w AS v4, lag(v, 6) OVER w AS v6, lag(v, 10) OVER w AS v10 FROM x WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
d AS (SELECT vec_id, i, CAST(v - coalesce(v4, v0) - coalesce(v6, v0) + coalesce(v10, v0) AS DOUBLE) AS d FROM f),
p AS (SELECT *, sum(d) OVER (PARTITION BY vec_id ORDER BY i) + 3.0::DOUBLE * d AS r FROM d),
t AS (SELECT vec_id, i, sum(r) OVER (PARTITION BY vec_id ORDER BY i) AS v FROM p)"""
ORACLE_SQL = {
    "waveform_baseline": f"WITH {LONG} SELECT vec_id, round(avg(v) FILTER (WHERE i < least(16, n // 2)), 6) AS baseline FROM x GROUP BY 1",
    "waveform_peak": f"""WITH {LONG}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v, i) AS a, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i DESC) AS b FROM x WHERE i >= least(16, n // 2))
        SELECT vec_id, max(v) FILTER (WHERE a = 1) AS low, max(i) FILTER (WHERE a = 1) AS low_at, max(v) FILTER (WHERE b = 1) AS high, max(i) FILTER (WHERE b = 1) AS high_at FROM r GROUP BY 1""",
    "waveform_charge": f"""WITH {LONG}, k AS (SELECT vec_id, arg_max(i, (v, i)) AS pk, avg(v) FILTER (WHERE i < least(8, n // 2)) AS b FROM x GROUP BY 1)
        SELECT vec_id, round(sum(v) - any_value(b) * count(*), 6) AS charge FROM x JOIN k USING (vec_id) WHERE i >= greatest(pk - 4, 0) AND i < least(pk + 8, n) GROUP BY 1""",
    "waveform_stats": f"""WITH {LONG}, a AS (SELECT vec_id, channel, max(v) - min(v) AS amplitude, count(*) AS n FROM x GROUP BY ALL)
        SELECT channel, count(*) AS traces, CAST(sum(n) AS BIGINT) AS samples, min(amplitude) AS least, max(amplitude) AS most, round(avg(amplitude), 6) AS mean FROM a GROUP BY 1""",
    "waveform_explode": f"WITH {LONG} SELECT vec_id, i AS sample_idx, i * ns_per_sample AS time_ns, v AS adc FROM x",
    "waveform_explode_all": f"WITH {LONG} SELECT vec_id, i AS sample_idx, i * ns_per_sample AS time_ns, v AS adc FROM x",
    "moving_average": f"WITH {LONG} SELECT vec_id, i, round(avg(v) OVER (PARTITION BY vec_id ORDER BY i ROWS 4 PRECEDING), 6) AS v FROM x",
    "trapezoid": f"WITH {TRAP} SELECT vec_id, i, round(v, 3) AS v FROM t",
    "trapezoid_energy": f"WITH {TRAP} SELECT vec_id, round(avg(v) FILTER (WHERE i >= 22 AND i < 30) - avg(v) FILTER (WHERE i < 12), 3) AS energy FROM t GROUP BY 1",
    "probe_edges": f"WITH {LONG} SELECT vec_id, CAST(min(i) FILTER (WHERE v > 1000) AS BIGINT) AS edge, CAST(floor(avg(i) FILTER (WHERE v > 1000)) AS BIGINT) AS centre FROM x GROUP BY 1",
    "deinterleaved": f"""WITH {LONG} SELECT vec_id, CAST(2 * sum(v) FILTER (WHERE i % 2 = 0) AS BIGINT) AS even_sum, CAST(2 * sum(v) FILTER (WHERE i % 2 = 1) AS BIGINT) AS odd_sum FROM x GROUP BY 1""",
    "lanes": f"WITH {LONG} SELECT vec_id, CAST(sum(v + 32768) AS BIGINT) AS lane0, CAST(sum(v + 32768) AS BIGINT) AS lane1 FROM x GROUP BY 1",
    "pole_zero": f"""WITH {HITS_SQL}, t AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0 ELSE CAST(event_id % 100 AS DOUBLE) END AS tau FROM hits)
        SELECT event_id, round(CASE WHEN tau > 0 THEN 1 / (exp(1 / tau) - 1) ELSE 0 END, 6) AS multiplier FROM t""",
    "energy_scaling": f"WITH {HITS_SQL} SELECT event_id, CAST(trunc(least(greatest(energy * 1.75::DOUBLE - 500, 0), 65535)) AS INTEGER) AS scaled FROM hits",
}
