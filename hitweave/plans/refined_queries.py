"""Charges at the crossing time, summaries of traces and gaps, voltage steps, background lines, and runs looked up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import ledger
from ..operators import waveforms as V
from ..operators.histograms import hist1d
from ..operators.ordered import lag_global, with_range
from ..sources.hits import HITS_SQL, hits, table, waveforms
from .quality_queries import ranked_at
from .waveform_queries import LONG


def waveform_charge_cfd(spark, d):
    """Charge in a gate of 12 samples from 4 before the constant-fraction crossing on, or before the peak where none is found."""
    s = F.col("samples")
    rows = waveforms(spark, d).withColumn("c", V.crossing(0.5, 3, False)(s))
    anchor = F.when(F.col("c.valid"), F.greatest(F.col("c.time"), F.lit(0.0)).cast("int")).otherwise(V.extremum(s, False, 8)["index"])
    return rows.select("vec_id", F.col("c.valid").alias("at_crossing"), F.round(V.gated_charge(s, anchor - 4, 12, V.baseline(s, 8)), 6).alias("charge"))


def waveform_summary(spark, d):
    """Amplitude against a baseline of 32 samples, baseline, place of the least sample and span of all traces: means, deviations, extremes and percentiles by rounded index."""
    s = F.col("samples")
    low, high, ground = V.extremum(s, True), F.array_max(s), V.baseline(s, 32)
    per = waveforms(spark, d).filter(F.size(s) > 1).select(
        F.round(F.greatest(F.abs(low["value"] - ground), F.abs(high - ground)), 9).alias("amplitude"), ground.alias("ground"), low["index"].alias("place"), (high - low["value"]).alias("span"))
    plain = per.agg(
        F.count("*").alias("traces"), *[f(c).alias(f"{c}_{n}") for c in ("amplitude", "ground", "place") for n, f in (("mean", F.avg), ("dev", F.stddev_pop), ("min", F.min), ("max", F.max))], F.max("span").alias("span_max"))
    out = plain.select("traces", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in plain.columns[1:]])
    for column, wanted in (("amplitude", {"amplitude_p50": 0.5, "amplitude_p95": 0.95}), ("place", {"place_p50": 0.5}), ("span", {"span_p50": 0.5, "span_p95": 0.95})):
        found = ranked_at(per, column, {n: ("round", p) for n, p in wanted.items()})  # a single row
        out = out.join(F.broadcast(found.select(*[F.round(F.col(n).cast("double"), 6).alias(n) for n in wanted])))
    return out


def gap_histogram(spark, d):
    """Gaps between successive hits in 60 bins of a minute around their mean: bin, its lower edge against the mean, counts."""
    rows = lag_global(with_range(hits(spark, d), "timestamp_ns"), "timestamp_ns", ["timestamp_ns", "event_id"], {"prev": "timestamp_ns"})
    gaps = rows.select((F.col("timestamp_ns") - F.col("prev")).alias("gap")).filter("gap IS NOT NULL")
    mean = gaps.agg(F.round(F.avg("gap")).alias("mean"))  # a single row
    at = (F.col("gap") - (F.col("mean") - 1800e9)) / 60e9
    binned = gaps.join(F.broadcast(mean)).withColumn("bin", F.when(at >= 0, at.cast("int"))).filter("bin < 60")
    return binned.groupBy("bin").agg(F.count("*").alias("counts")).select("bin", (F.col("bin") * 60.0 - 1800).alias("from_s"), "counts")


def gain_steps(spark, d):
    """Voltage steps towards a peak at 20000 with a tolerance of 2 %, and why where there is none."""
    peak = F.when(F.col("event_id") % 17 != 0, F.when(F.col("event_id") % 19 == 0, F.lit(0.5)).otherwise(F.col("energy").cast("double")))
    voltage = F.when(F.col("event_id") % 23 == 0, F.lit(0.0)).otherwise(800.0 + F.col("event_id") % 100)
    new, status = C.gain_step(voltage, F.lit(20000.0), peak, 7.0, 20.0, 2.0)
    return hits(spark, d).select("event_id", F.round(new, 6).alias("voltage"), status.alias("status"))


def background_lines(spark, d):
    """Lines through the bins 2 to 20 and 60 to 80 of each channel's energies, null below three filled bins, and the chord from the left line at bin 20 to the right one at bin 60."""
    hist = hist1d(hits(spark, d).filter("event_id % 3 > 0 OR channel > 0"), ["module", "channel"], F.col("energy"), 0.0, 50000.0, 100)
    x, y = F.col("bin") * 500.0 + 250.0, F.col("counts").cast("double")

    def line(low: int, high: int, name: str):
        inside = F.col("bin").between(low, high)
        xs, ys = F.when(inside, x), F.when(inside, y)
        good = F.count(xs) >= 3
        return [F.when(good, F.regr_slope(ys, xs)).alias(f"{name}_slope"), F.when(good, F.regr_intercept(ys, xs)).alias(f"{name}_base")]

    lines = hist.groupBy("module", "channel").agg(*line(2, 20, "left"), *line(60, 80, "right"))
    at = lambda n, v: F.col(f"{n}_slope") * v + F.col(f"{n}_base")
    chord = (at("right", 30250.0) - at("left", 10250.0)) / 20000.0
    rounded = [F.round(F.col(c), 6).alias(c) for c in lines.columns[2:]]
    return lines.select("module", "channel", *rounded, F.round(chord, 6).alias("chord_slope"), F.round(at("left", 10250.0) - chord * 10250.0, 4).alias("chord_base"))


def _runs(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").cast("long").alias("run_number"), F.col("o_orderpriority").alias("exp_name"), F.col("o_orderdate").cast("date").alias("start_time"),
        F.when(F.col("o_orderkey") % 50 == 1, "running").otherwise("completed").alias("status"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))).alias("comment"))


def run_lookup(spark, d):
    """The current run, run 7, and all runs in order of their start as place and number."""
    rows = _runs(spark, d)
    named = [r.select(F.lit(n).alias("asked"), "run_number", "status", "comment") for n, r in (("current", ledger.current(rows)), ("by number", ledger.by_number(rows, 7)), ("unlimited", ledger.recent(rows, 0)))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def last_run_info(spark, d):
    """Number, comment and notes of the latest run of each experiment."""
    notes = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("run_number"), F.col("l_linenumber").cast("long").alias("time"), F.concat_ws(" ", "l_returnflag", F.col("l_quantity").cast("int").cast("string")).alias("text"))
    return ledger.last_info(_runs(spark, d), notes).select("exp_name", "run_number", "comment", F.array_join(F.transform("notes", lambda n: F.concat_ws(":", n["time"].cast("string"), n["text"])), ";").alias("notes"))


def four_lanes(spark, d):
    """Words of four different 16-bit lanes taken apart: sums of the samples of each by their place."""
    odd = lambda x, k: ((x + 32768) * (2 * k + 1) + 977 * k) % 65536
    words = F.transform("samples", lambda x: odd(x, 0).cast("long").bitwiseOR(F.shiftleft(odd(x, 1).cast("long"), 16)).bitwiseOR(F.shiftleft(odd(x, 2).cast("long"), 32)).bitwiseOR(F.shiftleft(odd(x, 3).cast("long"), 48)))
    rows = waveforms(spark, d).select("vec_id", words.alias("w"))
    weighted = lambda k: F.aggregate(F.transform(V.lane(F.col("w"), k), lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("vec_id", *[weighted(k).alias(f"lane{k}") for k in range(4)])


QUERIES = {f.__name__: f for f in (waveform_charge_cfd, waveform_summary, gap_histogram, gain_steps, background_lines, run_lookup, last_run_info, four_lanes)}

CROSSING = f"""{LONG}, g AS (SELECT vec_id, avg(v) FILTER (WHERE i < least(8, n // 2)) AS b, arg_max(i, (v, i)) FILTER (WHERE i >= least(8, n // 2)) AS pk, any_value(n) AS n FROM x GROUP BY 1),
y AS (SELECT x.vec_id, i, v, x.n, b, pk, (v - b) * 0.5::DOUBLE - lag(v - b, 3) OVER (PARTITION BY x.vec_id ORDER BY i) AS s FROM x JOIN g USING (vec_id)),
z AS (SELECT *, lead(s) OVER (PARTITION BY vec_id ORDER BY i) AS later FROM y),
m AS (SELECT vec_id, max(i) AS at FROM z WHERE s > 0 AND later <= 0 AND i < pk AND i > greatest(pk - 16, 8, 4) GROUP BY 1),
cfd AS (SELECT g.vec_id, g.b, g.n, g.pk, m.at IS NOT NULL AS valid, coalesce(m.at + z.s / (z.s - z.later), CAST(g.pk AS DOUBLE)) AS time
        FROM g LEFT JOIN m USING (vec_id) LEFT JOIN z ON z.vec_id = m.vec_id AND z.i = m.at)"""
RUNS = """r AS (SELECT CAST(o_orderkey AS BIGINT) AS run_number, o_orderpriority AS exp_name, CAST(o_orderdate AS DATE) AS start_time, CASE WHEN o_orderkey % 50 = 1 THEN 'running' ELSE 'completed' END AS status,
    CASE WHEN o_orderkey % 3 > 0 THEN concat('customer ', o_custkey) END AS comment FROM orders)"""
ORACLE_SQL = {
    "waveform_charge_cfd": f"""WITH {CROSSING}, a AS (SELECT *, CASE WHEN valid THEN CAST(trunc(greatest(time, 0)) AS INTEGER) ELSE pk END AS anchor FROM cfd)
        SELECT a.vec_id, valid AS at_crossing, round(sum(v) - any_value(a.b) * count(*), 6) AS charge FROM a JOIN x ON x.vec_id = a.vec_id AND x.i >= greatest(anchor - 4, 0) AND x.i < least(anchor + 8, a.n) GROUP BY ALL""",
    "cfd_time": f"WITH {CROSSING} SELECT vec_id, round(time, 6) AS time, valid FROM cfd",
    "waveform_summary": f"""WITH {LONG}, p AS (SELECT vec_id, avg(v) FILTER (WHERE i < least(32, n // 2)) AS ground, min(v) AS low, max(v) AS high, arg_min(i, (v, i)) AS place FROM x GROUP BY 1),
        q AS (SELECT *, round(greatest(abs(low - ground), abs(high - ground)), 9) AS amplitude, high - low AS span FROM p),
        k AS (SELECT *, row_number() OVER (ORDER BY amplitude) - 1 AS ka, row_number() OVER (ORDER BY place) - 1 AS kp, row_number() OVER (ORDER BY span) - 1 AS ks, count(*) OVER () - 1 AS m FROM q)
        SELECT count(*) AS traces, {", ".join(f"round(CAST({f}({c}) AS DOUBLE), 6) AS {c}_{n}" for c in ("amplitude", "ground", "place") for n, f in (("mean", "avg"), ("dev", "stddev_pop"), ("min", "min"), ("max", "max")))},
               CAST(max(span) AS DOUBLE) AS span_max, round(max(amplitude) FILTER (WHERE ka = floor(m * 0.5 + 0.5)), 6) AS amplitude_p50, round(max(amplitude) FILTER (WHERE ka = floor(m * 0.95 + 0.5)), 6) AS amplitude_p95,
               CAST(max(place) FILTER (WHERE kp = floor(m * 0.5 + 0.5)) AS DOUBLE) AS place_p50, CAST(max(span) FILTER (WHERE ks = floor(m * 0.5 + 0.5)) AS DOUBLE) AS span_p50,
               CAST(max(span) FILTER (WHERE ks = floor(m * 0.95 + 0.5)) AS DOUBLE) AS span_p95 FROM k""",
    "gap_histogram": f"""WITH {HITS_SQL}, g AS (SELECT timestamp_ns - lag(timestamp_ns) OVER (ORDER BY timestamp_ns, event_id) AS gap FROM hits), m AS (SELECT round(avg(gap)) AS mean FROM g),
        b AS (SELECT (gap - (mean - 1800e9::DOUBLE)) / 60e9::DOUBLE AS p FROM g, m WHERE gap IS NOT NULL)
        SELECT CAST(floor(p) AS INTEGER) AS bin, floor(p) * 60.0::DOUBLE - 1800 AS from_s, count(*) AS counts FROM b WHERE p >= 0 AND p < 60 GROUP BY ALL""",
    "gain_steps": f"""WITH {HITS_SQL}, x AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 0.5::DOUBLE ELSE CAST(energy AS DOUBLE) END AS p,
            CASE WHEN event_id % 23 = 0 THEN 0.0::DOUBLE ELSE 800.0::DOUBLE + event_id % 100 END AS v FROM hits),
        s AS (SELECT *, CASE WHEN p IS NULL THEN 'FIT FAIL' WHEN p <= 1 THEN 'PEAK TOO LOW' WHEN abs(p - 20000) <= 400 THEN 'CONVERGED' WHEN v < 1 THEN 'HV OFF/ZERO' ELSE 'ADJUSTING' END AS status FROM x)
        SELECT event_id, CASE WHEN status = 'ADJUSTING' THEN round(greatest(v + least(greatest(v * pow(20000.0::DOUBLE / p, 1.0::DOUBLE / 7.0::DOUBLE) - v, -20), 20), 0), 6) END AS voltage, status FROM s""",
    "background_lines": f"""WITH {HITS_SQL}, h AS (SELECT module, channel, energy // 500 AS bin, CAST(count(*) AS DOUBLE) AS y FROM hits WHERE event_id % 3 > 0 OR channel > 0 GROUP BY ALL),
        b AS (SELECT module, channel, bin * 500.0::DOUBLE + 250 AS x, y, bin BETWEEN 2 AND 20 AS l, bin BETWEEN 60 AND 80 AS r FROM h),
        f AS (SELECT module, channel, {", ".join(f"CASE WHEN count(*) FILTER ({s}) >= 3 THEN {f}(y, x) FILTER ({s}) END AS {n}_{o}" for s, n in (("l", "left"), ("r", "right")) for f, o in (("regr_slope", "slope"), ("regr_intercept", "base")))} FROM b GROUP BY ALL),
        c AS (SELECT *, ((right_slope * 30250 + right_base) - (left_slope * 10250 + left_base)) / 20000 AS chord FROM f)
        SELECT module, channel, {", ".join(f"round({n}_{o}, 6) AS {n}_{o}" for n in ("left", "right") for o in ("slope", "base"))}, round(chord, 6) AS chord_slope,
               round(left_slope * 10250 + left_base - chord * 10250, 4) AS chord_base FROM c""",
    "run_lookup": f"""WITH {RUNS} SELECT * FROM (SELECT 'current' AS asked, run_number, status, comment FROM r WHERE status = 'running' ORDER BY start_time DESC, run_number DESC LIMIT 1)
        UNION ALL SELECT 'by number', run_number, status, comment FROM r WHERE run_number = 7 UNION ALL SELECT 'unlimited', run_number, status, comment FROM r""",
    "last_run_info": f"""WITH {RUNS}, l AS (SELECT exp_name, arg_max(run_number, (start_time, run_number)) AS run_number FROM r GROUP BY 1)
        SELECT l.exp_name, l.run_number, coalesce(r.comment, '') AS comment,
               coalesce((SELECT string_agg(l_linenumber || ':' || l_returnflag || ' ' || CAST(trunc(l_quantity) AS INTEGER), ';' ORDER BY l_linenumber, l_returnflag || ' ' || CAST(trunc(l_quantity) AS INTEGER)) FROM lineitem WHERE l_orderkey = l.run_number), '') AS notes
        FROM l JOIN r ON r.run_number = l.run_number""",
    "four_lanes": f"""WITH {LONG} SELECT vec_id, {", ".join(f"CAST(sum((((v + 32768) * {2 * k + 1} + {977 * k}) % 65536) * (i + 1)) AS BIGINT) AS lane{k}" for k in range(4))} FROM x GROUP BY 1""",
}
