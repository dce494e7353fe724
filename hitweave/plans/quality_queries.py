"""Stream quality, losses, statistics and run metadata."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.durable import durable
from ..operators.ordered import extended_counter, lag_global, with_range
from ..sources.hits import BATCHES_SQL, HITS_SQL, RUNS_SQL, batches, hits, runs, table

KEYS = ["module", "channel"]


def _with_last(rows, *names: str):
    """Adds ``last_<name>`` of the row before of the same source, in order of arrival."""
    return lag_global(rows, "event_id", ["event_id"], {f"last_{n}": n for n in names}, ["source_id"])


def seq_gaps(spark, d):
    """Gaps and restarts of each source's numbering; a number below ``last - 100`` is a restart."""
    rows = _with_last(batches(spark, d), "sequence_number")
    seq, last = F.col("sequence_number"), F.col("last_sequence_number")
    restart = seq < F.greatest(last - 100, F.lit(0))
    gap = F.when(~restart & (seq > last + 1), seq - last - 1).otherwise(0)
    rows = rows.select("source_id", restart.alias("restart"), gap.alias("gap"))
    return rows.groupBy("source_id").agg(F.count("*").alias("batches"), F.count_if("restart").alias("restarts"), F.count_if(F.col("gap") > 0).alias("gaps"), F.sum("gap").alias("lost"))


def trigger_loss_flag(spark, d):
    return hits(spark, d).groupBy("module").agg((F.lit(1024) * F.count_if(F.col("flags").bitwiseAND(F.lit(16)) != 0)).alias("lost"), F.count("*").alias("hits"))


def trigger_loss_counter(spark, d):
    """Lost triggers from two 24-bit counters that wrap."""
    rows = batches(spark, d).select("source_id", "event_id", (F.col("event_id") * 700_001 % (1 << 24)).alias("trig"), (F.col("event_id") * 690_000 % (1 << 24)).alias("saved"))
    rows = _with_last(rows, "trig", "saved")
    rows = rows.withColumn("dt", F.pmod(F.col("trig") - F.col("last_trig"), F.lit(1 << 24))).withColumn("ds", F.pmod(F.col("saved") - F.col("last_saved"), F.lit(1 << 24)))
    return rows.groupBy("source_id").agg(F.sum(F.greatest(F.lit(0), F.col("dt") - F.col("ds"))).alias("lost"), F.sum("dt").alias("triggers"))


def loss_percent(spark, d):
    found = trigger_loss_counter(spark, d)
    return found.select("source_id", F.round(F.when(F.col("triggers") > 0, F.col("lost") * 100.0 / F.col("triggers")).otherwise(0.0), 9).alias("percent"))


def rollover_extend(spark, d):
    """A 20-bit counter made monotone: a fall of over half a period begins the next one."""
    rows = batches(spark, d).select("source_id", "event_id", (F.col("event_id") * 300 % (1 << 20)).alias("raw"))
    return extended_counter(rows, "event_id", "raw", 20, ["source_id"]).select("source_id", "event_id", "extended")


def rollover_late(spark, d):
    """A 16-bit counter, one reading in eleven of which comes late by up to some thousand ticks."""
    ticks = F.col("event_id") * 900 - F.when(F.col("event_id") % 11 == 7, F.col("event_id") % 5 * 1500 + 4000).otherwise(0)
    rows = batches(spark, d).select("source_id", "event_id", F.pmod(ticks, F.lit(1 << 16)).alias("raw"))
    return extended_counter(rows, "event_id", "raw", 16, ["source_id"]).select("source_id", "event_id", "extended", "late")


def subcounter(spark, d):
    """A 16-bit counter placed against a wide one: one period less where it would be in the future and can be."""
    wide = F.col("event_id") * 40_000
    narrow = (F.col("event_id") * 39_990) % (1 << 16)
    guess = F.shiftleft(F.shiftright(wide, 16), 16).bitwiseOR(narrow)
    placed = F.when((guess > wide) & (guess >= (1 << 16)), guess - (1 << 16)).otherwise(guess)
    return hits(spark, d).select("event_id", placed.alias("placed"))


def dt_stats(spark, d):
    """Gaps between successive hits: mean, median and percentiles by index, population deviation."""
    rows = lag_global(with_range(hits(spark, d), "timestamp_ns"), "timestamp_ns", ["timestamp_ns", "event_id"], {"prev": "timestamp_ns"})
    gaps = rows.select((F.col("timestamp_ns") - F.col("prev")).alias("gap")).filter("gap is not null")
    total = gaps.agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("rms"))
    return total.join(F.broadcast(ranked_at(gaps, "gap", {"median": ("half", 0), "p01": ("floor", 0.01), "p99": ("floor", 0.99)}))).select(
        "n", F.round("mean", 3).alias("mean"), F.round(F.col("rms") / 1e9, 6).alias("rms_s"), "median", "p01", "p99"
    )


def ranked_at(rows, value: str, wanted: dict):
    """Values at given indexes of the sorted column, without interpolation, from counts of distinct values, written once and dealt to ranges."""
    counts = with_range(durable(rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))), value)
    inside = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    parts = counts.groupBy("_range").agg(F.sum("c").alias("s"))
    shift = parts.select("_range", F.coalesce(F.sum("s").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("s").over(Window.partitionBy()).alias("n"))
    placed = counts.withColumn("upto", F.sum("c").over(inside)).join(F.broadcast(shift), "_range").select(value, (F.col("upto") + F.col("before")).alias("upto"), "c", "n")
    index = {
        "half": lambda p: F.expr("n div 2"), "floor": lambda p: F.floor(F.col("n") * F.lit(p)).cast("long"),
        "round": lambda p: F.floor((F.col("n") - 1) * F.lit(p) + 0.5).cast("long"),
    }
    hit = {k: (F.col("upto") > F.least(index[how](p), F.col("n") - 1)) & (F.col("upto") - F.col("c") <= F.least(index[how](p), F.col("n") - 1)) for k, (how, p) in wanted.items()}
    return placed.agg(*[F.max(F.when(c, F.col(value))).alias(k) for k, c in hit.items()])


def percentiles_rounded(spark, d):
    """Energies at rounded indexes of the sorted column."""
    return ranked_at(hits(spark, d), "energy", {"p05": ("round", 0.05), "p50": ("round", 0.5), "p95": ("round", 0.95)})


def module_summary(spark, d):
    """Count, span, rate and coverage of each module against module 0."""
    per = hits(spark, d).groupBy("module").agg(F.count("*").alias("hits"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))
    per = per.withColumn("range_s", (F.col("last_ns") - F.col("first_ns")) / 1e9)
    base = per.filter("module = 0").select(F.col("range_s").alias("base_s"))
    rate = F.when(F.col("range_s") > 0, F.col("hits") / F.col("range_s")).otherwise(0.0)
    return per.join(F.broadcast(base)).select("module", "hits", "first_ns", "last_ns", F.round(rate, 9).alias("rate"), F.round(F.col("range_s") * 100 / F.col("base_s"), 6).alias("coverage"))


def channel_counts(spark, d):
    return hits(spark, d).filter("channel < 32").groupBy(*KEYS).agg(F.count("*").alias("hits"))


def channel_topk(spark, d):
    return channel_counts(spark, d).orderBy(F.desc("hits"), *KEYS).limit(12)


def latest_per_channel(spark, d):
    return hits(spark, d).groupBy(*KEYS).agg(F.max_by(F.struct("event_id", "energy"), "event_id").alias("h")).select(*KEYS, "h.event_id", "h.energy")


def fine_time_stats(spark, d):
    rows = hits(spark, d).select("module", (F.col("event_id") * 37 % 1024).cast("int").alias("fine"))
    bins = rows.withColumn("bin", F.least(F.expr("fine * 10 div 1024"), F.lit(9)).cast("int")).groupBy("module", "bin").agg(
        F.count("*").alias("counts"), F.min("fine").alias("low"), F.max("fine").alias("high"), F.round(F.avg("fine"), 6).alias("mean"))
    return bins


def regression_fit(spark, d):
    """Line of short over full charge by channel; slope 0 and the mean without spread."""
    x, y = F.col("energy").cast("double"), F.col("energy_short").cast("double")
    per = hits(spark, d).groupBy("channel").agg(F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"), F.corr(x, y).alias("r"), F.avg(y).alias("m"), F.count("*").alias("n"))
    slope, r = F.coalesce(F.nanvl("s", F.lit(0.0)), F.lit(0.0)), F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0))
    return per.select("channel", "n", F.round(slope, 6).alias("slope"), F.round(F.coalesce("i", "m"), 3).alias("intercept"), F.round(r, 6).alias("r"), (r * r > 0.9).alias("good"))


def rate_deltas(spark, d):
    """Rates between hourly snapshots of a cumulative counter, never below 0."""
    hourly = hits(spark, d).groupBy("module", F.floor(F.col("timestamp_ns") / 3.6e12).alias("hour")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("module").orderBy("hour")
    total = hourly.withColumn("total", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return total.select("module", "hour", F.greatest(F.lit(0), F.col("total") - F.coalesce(F.lag("total").over(w), F.lit(0))).alias("delta"),
                        F.round((F.col("total") - F.lag("total").over(w)) / (F.col("hour") - F.lag("hour").over(w)), 6).alias("rate"))


def run_stats(spark, d):
    """Totals of recorder components, losses of all, average rate over the elapsed time."""
    r = runs(spark, d).withColumn("component", F.when(F.col("run_number") % 4 == 0, "recorder").otherwise("reader")).withColumn("elapsed", (F.col("run_number") % 7).cast("long"))
    recorder = F.when(F.col("component") == "recorder", F.col("total_events")).otherwise(0)
    per = r.groupBy("exp_name").agg(F.sum(recorder).alias("events"), F.sum(F.col("total_events") % 5).alias("lost"), F.sum("elapsed").alias("elapsed"))
    return per.select("exp_name", "events", "lost", F.round(F.when(F.col("elapsed") > 0, F.col("events") / F.col("elapsed")).otherwise(0.0), 6).alias("average_rate"))


def eos_state(spark, d):
    """Runs close once every source that sent data has sent its end mark."""
    rows = hits(spark, d).select(F.expr("event_id div 1000").alias("run_number"), F.col("module").alias("source_id"), (F.col("event_id") % 50 == 49).alias("eos"))
    sources = rows.groupBy("run_number", "source_id").agg(F.bool_or(~F.col("eos")).alias("data"), F.bool_or("eos").alias("ended"))
    return sources.groupBy("run_number").agg(F.count_if("data").alias("sources"), F.count_if(F.col("data") & F.col("ended")).alias("ended"), F.bool_and(~F.col("data") | F.col("ended")).alias("closed"))


def recent_runs(spark, d):
    return runs(spark, d).orderBy(F.desc("start_time"), F.desc("run_number")).limit(25)


def runs_by_experiment(spark, d):
    return runs(spark, d).groupBy("exp_name").agg(F.count("*").alias("runs"), F.max(F.struct("start_time", "run_number")).alias("m")).select("exp_name", "runs", F.col("m.run_number").alias("last_run"), F.col("m.start_time").alias("last_start"))


def next_run_number(spark, d):
    """The next number of all runs, and of each experiment after its latest run."""
    r = runs(spark, d)
    top = r.agg((F.max("run_number") + 1).alias("next_global"))
    per = r.groupBy("exp_name").agg(F.max_by("run_number", F.struct("start_time", "run_number")).alias("n"))
    return per.join(F.broadcast(top)).select("exp_name", (F.col("n") + 1).alias("next_run"), "next_global")


def versioned_configs(spark, d):
    """The current version of each document, with how many versions it has."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("serial"), F.col("o_orderkey").cast("long").alias("saved"), F.col("o_orderpriority").alias("body"))
    w = Window.partitionBy("serial").orderBy("saved")
    versions = rows.withColumn("version", F.row_number().over(w)).withColumn("is_current", F.lead("saved").over(w).isNull())
    return versions.filter("is_current").select("serial", "version", "body")


def config_history(spark, d):
    """The latest three versions of each document, as a clean-up keeps them."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("serial"), F.col("o_orderkey").cast("long").alias("saved"))
    newest = F.row_number().over(Window.partitionBy("serial").orderBy(F.desc("saved")))
    return rows.withColumn("age", newest).filter("age <= 3").select("serial", "saved", "age")


def run_export(spark, d):
    """Runs with the snapshot of their settings where one was kept, newest first."""
    snap = table(spark, d, "lineitem").filter("l_linenumber = 1 and l_quantity > 25").select(F.col("l_orderkey").cast("long").alias("run_number"), F.col("l_returnflag").alias("snapshot"))
    return runs(spark, d).join(snap, "run_number", "left").select("run_number", "exp_name", "snapshot")


def dashboard_rates(spark, d):
    """Hit counts per ten minutes of the last day, over ten, in time order."""
    return spark.sql("""
        SELECT module, CAST(floor(timestamp_ns / 6e11) AS BIGINT) AS slot, count(*) / 10.0D AS event_rate FROM {h}
        WHERE timestamp_ns > (SELECT max(timestamp_ns) FROM {h}) - 86400e9D AND module IN (1, 3) GROUP BY module, slot ORDER BY slot, module""", h=hits(spark, d))


def line_protocol(spark, d):
    """Metric lines of channels that counted anything."""
    rows = channel_counts(spark, d).filter("hits > 0")
    return rows.select(F.format_string("channel_rate,module=%d,channel=%d count=%di", "module", "channel", "hits").alias("line"))


def throughput_filter(spark, d):
    """Rows whose size is within 0.6 to 1.4 of the predicted one, averaged by sample count."""
    rows = hits(spark, d).select((F.col("channel") * 100 + 100).alias("samples"), (F.col("energy") % 3000).cast("double").alias("size"), F.col("energy_short").alias("rate"))
    ratio = F.col("size") / (8 * (4 + F.col("samples") / 2.0))
    return rows.filter(ratio.between(0.6, 1.4)).groupBy("samples").agg(F.count("*").alias("n"), F.round(F.avg("rate"), 6).alias("rate"))


QUERIES = {f.__name__: f for f in (
    seq_gaps, trigger_loss_flag, trigger_loss_counter, loss_percent, rollover_extend, rollover_late, subcounter, dt_stats, percentiles_rounded, module_summary, channel_counts,
    channel_topk, latest_per_channel, fine_time_stats, regression_fit, rate_deltas, run_stats, eos_state, recent_runs, runs_by_experiment,
    next_run_number, versioned_configs, config_history, run_export, dashboard_rates, line_protocol, throughput_filter,
)}

B = f"{HITS_SQL}, {BATCHES_SQL}"
COUNTER = f"""{B}, c AS (SELECT source_id, event_id, event_id * 700001 % 16777216 AS trig, event_id * 690000 % 16777216 AS saved FROM batches),
l AS (SELECT *, (trig - lag(trig) OVER w + 16777216) % 16777216 AS dt, (saved - lag(saved) OVER w + 16777216) % 16777216 AS ds FROM c WINDOW w AS (PARTITION BY source_id ORDER BY event_id)),
t AS (SELECT source_id, CAST(sum(greatest(0, dt - ds)) AS BIGINT) AS lost, CAST(sum(dt) AS BIGINT) AS triggers FROM l WHERE dt IS NOT NULL GROUP BY 1)"""
ORACLE_SQL = {
    "seq_gaps": f"""WITH {B}, l AS (SELECT *, lag(sequence_number) OVER (PARTITION BY source_id ORDER BY event_id) AS last FROM batches),
        g AS (SELECT source_id, coalesce(sequence_number < greatest(last - 100, 0), false) AS r, sequence_number AS s, last FROM l)
        SELECT source_id, count(*) AS batches, count(*) FILTER (WHERE r) AS restarts, count(*) FILTER (WHERE NOT r AND s > last + 1) AS gaps,
               CAST(sum(CASE WHEN NOT r AND s > last + 1 THEN s - last - 1 ELSE 0 END) AS BIGINT) AS lost FROM g GROUP BY 1""",
    "trigger_loss_flag": f"WITH {HITS_SQL} SELECT module, 1024 * count(*) FILTER (WHERE flags & 16 <> 0) AS lost, count(*) AS hits FROM hits GROUP BY 1",
    "trigger_loss_counter": f"WITH {COUNTER} SELECT * FROM t",
    "loss_percent": f"WITH {COUNTER} SELECT source_id, round(CASE WHEN triggers > 0 THEN lost * 100.0::DOUBLE / triggers ELSE 0 END, 9) AS percent FROM t",
    "rollover_extend": f"""WITH {B}, r AS (SELECT source_id, event_id, event_id * 300 % 1048576 AS raw FROM batches),
        l AS (SELECT *, lag(raw) OVER (PARTITION BY source_id ORDER BY event_id) AS prev FROM r)
        SELECT source_id, event_id, CAST(sum(CASE WHEN raw < prev THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY event_id) * 1048576 + raw AS BIGINT) AS extended FROM l""",
    "rollover_late": f"""WITH RECURSIVE {B}, r AS (SELECT source_id, event_id, (event_id * 900 - CASE WHEN event_id % 11 = 7 THEN event_id % 5 * 1500 + 4000 ELSE 0 END + 65536 * 4) % 65536 AS raw,
            row_number() OVER (PARTITION BY source_id ORDER BY event_id) AS i FROM batches),
        s AS (SELECT source_id, event_id, i, raw AS prev, CAST(0 AS BIGINT) AS epoch, CAST(raw AS BIGINT) AS extended, false AS late FROM r WHERE i = 1
            UNION ALL
            SELECT r.source_id, r.event_id, r.i, CASE WHEN f <= 32768 THEN r.raw ELSE prev END, CASE WHEN f <= 32768 AND r.raw < prev THEN epoch + 1 ELSE epoch END,
                   CASE WHEN f <= 32768 THEN CASE WHEN r.raw < prev THEN epoch + 1 ELSE epoch END * 65536 + r.raw WHEN epoch > 0 THEN (epoch - 1) * 65536 + r.raw END, f > 32768
            FROM (SELECT r.*, s.prev, s.epoch, (r.raw - s.prev + 65536) % 65536 AS f FROM s JOIN r ON r.source_id = s.source_id AND r.i = s.i + 1) r)
        SELECT source_id, event_id, extended, late FROM s""",
    "subcounter": f"""WITH {HITS_SQL}, g AS (SELECT event_id, event_id * 40000 AS wide, ((event_id * 40000) >> 16) * 65536 + event_id * 39990 % 65536 AS guess FROM hits)
        SELECT event_id, CASE WHEN guess > wide AND guess >= 65536 THEN guess - 65536 ELSE guess END AS placed FROM g""",
    "dt_stats": f"""WITH {HITS_SQL}, g AS (SELECT timestamp_ns - lag(timestamp_ns) OVER (ORDER BY timestamp_ns, event_id) AS gap FROM hits),
        r AS (SELECT gap, row_number() OVER (ORDER BY gap) - 1 AS i, count(*) OVER () AS n FROM g WHERE gap IS NOT NULL)
        SELECT count(*) AS n, round(avg(gap), 3) AS mean, round(stddev_pop(gap) / 1e9, 6) AS rms_s, max(gap) FILTER (WHERE i = n // 2) AS median,
               max(gap) FILTER (WHERE i = CAST(floor(n * 0.01::DOUBLE) AS BIGINT)) AS p01, max(gap) FILTER (WHERE i = CAST(floor(n * 0.99::DOUBLE) AS BIGINT)) AS p99 FROM r""",
    "percentiles_rounded": f"""WITH {HITS_SQL}, r AS (SELECT energy, row_number() OVER (ORDER BY energy) - 1 AS i, count(*) OVER () AS n FROM hits)
        SELECT """ + ", ".join(f"max(energy) FILTER (WHERE i = CAST(floor((n - 1) * {p}::DOUBLE + 0.5) AS BIGINT)) AS {k}" for k, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))) + " FROM r",
    "module_summary": f"""WITH {HITS_SQL}, p AS (SELECT module, count(*) AS hits, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns, (max(timestamp_ns) - min(timestamp_ns)) / 1e9 AS range_s FROM hits GROUP BY 1)
        SELECT module, hits, first_ns, last_ns, round(hits / range_s, 9) AS rate, round(range_s * 100 / (SELECT range_s FROM p WHERE module = 0), 6) AS coverage FROM p""",
    "channel_counts": f"WITH {HITS_SQL} SELECT module, channel, count(*) AS hits FROM hits GROUP BY ALL",
    "channel_topk": f"WITH {HITS_SQL} SELECT module, channel, count(*) AS hits FROM hits GROUP BY ALL ORDER BY hits DESC, module, channel LIMIT 12",
    "latest_per_channel": f"WITH {HITS_SQL} SELECT module, channel, max(event_id) AS event_id, arg_max(energy, event_id) AS energy FROM hits GROUP BY ALL",
    "fine_time_stats": f"""WITH {HITS_SQL}, r AS (SELECT module, CAST(event_id * 37 % 1024 AS INTEGER) AS fine FROM hits)
        SELECT module, CAST(least(fine * 10 // 1024, 9) AS INTEGER) AS bin, count(*) AS counts, min(fine) AS low, max(fine) AS high, round(avg(fine), 6) AS mean FROM r GROUP BY ALL""",
    "regression_fit": f"""WITH {HITS_SQL}, p AS (SELECT channel, count(*) AS n, regr_slope(CAST(energy_short AS DOUBLE), energy) AS s, regr_intercept(CAST(energy_short AS DOUBLE), energy) AS i, corr(energy, CAST(energy_short AS DOUBLE)) AS r FROM hits GROUP BY 1)
        SELECT channel, n, round(s, 6) AS slope, round(i, 3) AS intercept, round(r, 6) AS r, r * r > 0.9 AS good FROM p""",
    "rate_deltas": f"""WITH {HITS_SQL}, h AS (SELECT module, CAST(floor(timestamp_ns / 3.6e12) AS BIGINT) AS hour, count(*) AS n FROM hits GROUP BY ALL)
        SELECT module, hour, n AS delta, round(n / CAST(hour - lag(hour) OVER (PARTITION BY module ORDER BY hour) AS DOUBLE), 6) AS rate FROM h""",
    "run_stats": f"""WITH {RUNS_SQL}, p AS (SELECT exp_name, sum(CASE WHEN run_number % 4 = 0 THEN total_events ELSE 0 END) AS events, sum(total_events % 5) AS lost, sum(run_number % 7) AS elapsed FROM runs GROUP BY 1)
        SELECT exp_name, CAST(events AS BIGINT) AS events, CAST(lost AS BIGINT) AS lost, round(CASE WHEN elapsed > 0 THEN events / CAST(elapsed AS DOUBLE) ELSE 0 END, 6) AS average_rate FROM p""",
    "eos_state": f"""WITH {HITS_SQL}, s AS (SELECT event_id // 1000 AS run_number, module, bool_or(event_id % 50 <> 49) AS data, bool_or(event_id % 50 = 49) AS ended FROM hits GROUP BY ALL)
        SELECT run_number, count(*) FILTER (WHERE data) AS sources, count(*) FILTER (WHERE data AND ended) AS ended, bool_and(NOT data OR ended) AS closed FROM s GROUP BY 1""",
    "recent_runs": f"WITH {RUNS_SQL} SELECT * FROM runs ORDER BY start_time DESC, run_number DESC LIMIT 25",
    "runs_by_experiment": f"WITH {RUNS_SQL} SELECT exp_name, count(*) AS runs, arg_max(run_number, (start_time, run_number)) AS last_run, max(start_time) AS last_start FROM runs GROUP BY 1",
    "next_run_number": f"WITH {RUNS_SQL} SELECT exp_name, arg_max(run_number, (start_time, run_number)) + 1 AS next_run, (SELECT max(run_number) + 1 FROM runs) AS next_global FROM runs GROUP BY 1",
    "versioned_configs": """SELECT CAST(o_custkey AS BIGINT) AS serial, CAST(count(*) AS INTEGER) AS version, arg_max(o_orderpriority, o_orderkey) AS body FROM orders GROUP BY o_custkey""",
    "config_history": """SELECT serial, saved, CAST(age AS INTEGER) AS age FROM (SELECT CAST(o_custkey AS BIGINT) AS serial, CAST(o_orderkey AS BIGINT) AS saved,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS age FROM orders) WHERE age <= 3""",
    "run_export": f"""WITH {RUNS_SQL}, s AS (SELECT CAST(l_orderkey AS BIGINT) AS run_number, l_returnflag AS snapshot FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 25)
        SELECT run_number, exp_name, snapshot FROM runs LEFT JOIN s USING (run_number)""",
    "dashboard_rates": f"""WITH {HITS_SQL} SELECT module, CAST(floor(timestamp_ns / 6e11) AS BIGINT) AS slot, count(*) / 10.0::DOUBLE AS event_rate FROM hits
        WHERE timestamp_ns > (SELECT max(timestamp_ns) FROM hits) - 86400e9::DOUBLE AND module IN (1, 3) GROUP BY ALL""",
    "line_protocol": f"WITH {HITS_SQL} SELECT printf('channel_rate,module=%d,channel=%d count=%di', module, channel, count(*)) AS line FROM hits WHERE channel < 32 GROUP BY module, channel",
    "throughput_filter": f"""WITH {HITS_SQL}, r AS (SELECT channel * 100 + 100 AS samples, CAST(energy % 3000 AS DOUBLE) AS size, energy_short AS rate FROM hits)
        SELECT samples, count(*) AS n, round(avg(rate), 6) AS rate FROM r WHERE size / (8 * (4 + samples / 2.0::DOUBLE)) BETWEEN 0.6 AND 1.4 GROUP BY 1""",
}
