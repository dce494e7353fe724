"""Run and settings documents, voltage panels, dumps, channel scans and converters of older settings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fits, ledger
from ..operators.histograms import hist1d
from ..sources.hits import BATCHES_SQL, HITS_SQL, batches, hits, table
from ..sources.sinks import flat_records

KEYS = ["module", "channel"]


def batch_headers(spark, d):
    """Source and number of every batch; the payload is not read."""
    return batches(spark, d).select("source_id", "sequence_number")


def run_documents(spark, d):
    """Runs of 500 messages each; what follows the end changes nothing, and every seventh run still runs."""
    at, run = F.col("event_id") % 500, F.expr("event_id div 500")
    kind = F.when(at == 0, "start").when((at == 450) & (run % 7 != 6), "end").when(F.col("channel") == 4, "error").when(F.col("channel") == 3, "note").otherwise("stats")
    log = hits(spark, d).select(run.alias("run_number"), F.col("event_id").alias("seq"), F.floor(F.col("timestamp_ns") / 1e6).alias("time_ms"), kind.alias("kind"), F.col("energy").alias("value"))
    return ledger.run_documents(log)


def _eb_documents(spark, d):
    name = F.concat(F.lit("eb"), (F.col("o_custkey") % 7).cast("string"))
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("exp_name"), name.alias("name"), F.col("o_orderkey").cast("long").alias("saved"))


def eb_configs(spark, d):
    """The current event-building settings of each experiment."""
    return _eb_documents(spark, d).groupBy("exp_name", "name").agg(F.count("*").alias("version"), F.max("saved").alias("saved"))


def eb_experiments(spark, d):
    return _eb_documents(spark, d).select("exp_name").distinct()


def eb_history(spark, d):
    """The latest three versions of each of them."""
    rows = _eb_documents(spark, d)
    age = F.row_number().over(Window.partitionBy("exp_name", "name").orderBy(F.desc("saved")))
    counts = rows.groupBy("exp_name", "name").agg(F.count("*").alias("n"))
    newest = rows.withColumn("age", age).filter("age <= 3")
    return newest.join(counts, ["exp_name", "name"]).select("exp_name", "name", (F.col("n") - F.col("age") + 1).alias("version"), "saved", (F.col("age") == 1).alias("is_current"))


def _versions(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("serial"), F.col("o_orderkey").cast("long").alias("saved"), F.col("o_orderpriority").alias("body"))
    w = Window.partitionBy("serial").orderBy("saved")
    rows = rows.withColumn("version", F.row_number().over(w)).withColumn("is_current", F.lead("saved").over(w).isNull())
    return rows.drop("saved").withColumn("description", F.lit(None).cast("string"))


def config_restore(spark, d):
    """Every document of an even serial number gets its version 2 back, where it has one."""
    versions = _versions(spark, d)
    wanted = versions.filter("serial % 2 = 0 AND version = 2").select("serial", "version")
    return ledger.restored(versions, wanted, ["serial"])


def config_by_version(spark, d):
    return _versions(spark, d).filter("version = 2").select("serial", "version", "body")


def _voltages(spark, d):
    return hits(spark, d).select(F.col("timestamp_ns").alias("time"), (F.col("energy") / 100.0).alias("vmon"), F.col("module").cast("string").alias("slot"),
                                 F.concat(F.lit("ch"), F.col("channel").cast("string")).alias("name"), (F.col("event_id") % 5 != 0).cast("int").alias("pw"))


def voltage_panel(spark, d):
    """Voltages of the powered channels of one slot, in time order."""
    return _voltages(spark, d).filter("slot = '1' AND pw = 1").select("time", "vmon", "name").orderBy("time")


def voltage_latest(spark, d):
    """The newest 120 readings of some slots."""
    return _voltages(spark, d).filter("slot IN ('0', '2')").select("time", "vmon", "slot", "name").orderBy(F.desc("time")).limit(120)


def first_hits(spark, d):
    """The first 50 hits in time, as a dump shows them."""
    return hits(spark, d).orderBy("timestamp_ns", "event_id").limit(50).select("event_id", "module", "channel", "energy", "timestamp_ns")


def stop_tail(spark, d):
    """Batches of each source that pass, and those that came outside a run."""
    rows = ledger.running_only(batches(spark, d), F.expr("(event_id div 1000) % 3 <> 2"), F.expr("event_id % 1000 = 999"))
    return rows.groupBy("source_id").agg(F.count_if(~F.col("discarded")).alias("kept"), F.count_if("discarded").alias("discarded"))


def legacy_offsets(spark, d=None):
    """Offset entries against one reference from a table of offsets between all channels, whose diagonal is not 0."""
    cube = spark.sql("""SELECT transform(sequence(0, 3), a -> transform(sequence(0, 4), b -> transform(sequence(0, 3), m -> transform(sequence(0, 4), c ->
        1000.0D + (m * 5 + c) * 12.5D - (a * 5 + b) * 2.25D)))) AS cube""")
    return offsets_against(cube, "cube", 1, 2)


def offsets_against(rows, cube: str, module: int, channel: int):
    """Entries ``module, channel, ref_module, ref_channel, offset_ns`` from ``cube[ref module][ref channel][module][channel]``, less the reference's own."""
    seen = F.col(cube)[module][channel]
    flat = rows.select(seen[module][channel].alias("zero"), F.posexplode(seen).alias("module", "m")).select("zero", "module", F.posexplode("m").alias("channel", "ns"))
    root = (F.col("module") == module) & (F.col("channel") == channel)
    return flat.select("module", "channel", F.when(~root, F.lit(module)).alias("ref_module"), F.when(~root, F.lit(channel)).alias("ref_channel"),
                       F.when(root, 0.0).otherwise(F.col("ns") - F.col("zero")).alias("offset_ns"))


def flat_dump(spark, d):
    """Hits as flat records of 22 bytes, in hexadecimal."""
    return flat_records(hits(spark, d), ["event_id"]).select("event_id", F.hex("record").alias("record"))


def _lines(spark, d):
    """Hits whose energies gather at some thousand."""
    e = 1000 + F.col("energy") % 7 + F.col("energy_short") % 5 + F.col("event_id") % 3
    return hist1d(hits(spark, d).withColumn("v", e.cast("double")), KEYS, F.col("v"), 0.0, 65536.0, 65536)


def channel_scan(spark, d):
    """Strongest peak of each channel and the region around it."""
    return fits.scan_channels(_lines(spark, d), KEYS, 65536, height=10, prominence=5)


def gaussian_constant_fit(spark, d):
    """Gaussian on a constant in the region 990 to 1030 of each channel."""
    return fits.fit_regions(_lines(spark, d), KEYS, 990, 1030, least=100)


QUERIES = {f.__name__: f for f in (
    batch_headers, run_documents, eb_configs, eb_experiments, eb_history, config_restore, config_by_version, voltage_panel, voltage_latest, first_hits,
    stop_tail, legacy_offsets, flat_dump, channel_scan, gaussian_constant_fit,
)}

EB = "e AS (SELECT o_orderpriority AS exp_name, concat('eb', o_custkey % 7) AS name, CAST(o_orderkey AS BIGINT) AS saved FROM orders)"
VERSIONS = """v AS (SELECT CAST(o_custkey AS BIGINT) AS serial, o_orderpriority AS body, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS version,
    CAST(count(*) OVER (PARTITION BY o_custkey) AS INTEGER) AS n FROM orders)"""
VOLTAGES = f"WITH {HITS_SQL}, r AS (SELECT timestamp_ns AS time, energy / 100.0::DOUBLE AS vmon, CAST(module AS VARCHAR) AS slot, concat('ch', channel) AS name, event_id % 5 <> 0 AS pw FROM hits)"
ORACLE_SQL = {
    "batch_headers": f"WITH {HITS_SQL}, {BATCHES_SQL} SELECT source_id, sequence_number FROM batches",
    "run_documents": f"""WITH {HITS_SQL}, l AS (SELECT event_id // 500 AS run_number, event_id AS seq, CAST(floor(timestamp_ns / 1e6) AS BIGINT) AS ms, energy,
            CASE WHEN event_id % 500 = 0 THEN 'start' WHEN event_id % 500 = 450 AND event_id // 500 % 7 <> 6 THEN 'end' WHEN channel = 4 THEN 'error' WHEN channel = 3 THEN 'note' ELSE 'stats' END AS kind FROM hits),
        s AS (SELECT *, min(seq) FILTER (WHERE kind = 'start') OVER r AS s0, min(seq) FILTER (WHERE kind = 'end') OVER r AS s1 FROM l WINDOW r AS (PARTITION BY run_number)),
        a AS (SELECT run_number, min(ms) FILTER (WHERE seq = s0) AS start_ms, min(ms) FILTER (WHERE seq = s1) AS end_ms, arg_max(energy, seq) FILTER (WHERE kind IN ('stats', 'end')) AS total_events,
            count(*) FILTER (WHERE kind = 'error') AS errors, count(*) FILTER (WHERE kind = 'note') AS notes FROM s WHERE seq >= s0 AND (s1 IS NULL OR seq <= s1) GROUP BY 1)
        SELECT run_number, start_ms, end_ms, (end_ms - start_ms) // 1000 AS duration_s, CASE WHEN end_ms IS NULL THEN 'running' ELSE 'completed' END AS status, total_events, errors, notes FROM a""",
    "eb_configs": f"WITH {EB} SELECT exp_name, name, count(*) AS version, max(saved) AS saved FROM e GROUP BY ALL",
    "eb_experiments": f"WITH {EB} SELECT DISTINCT exp_name FROM e",
    "eb_history": f"""WITH {EB}, n AS (SELECT *, row_number() OVER (PARTITION BY exp_name, name ORDER BY saved) AS version, count(*) OVER (PARTITION BY exp_name, name) AS n FROM e)
        SELECT exp_name, name, version, saved, version = n AS is_current FROM n WHERE version > n - 3""",
    "config_restore": f"""WITH {VERSIONS} SELECT serial, body, version, version = n AND (serial % 2 = 1 OR n < 2) AS is_current, CAST(NULL AS VARCHAR) AS description FROM v
        UNION ALL SELECT serial, body, n + 1, true, 'Restored from version 2' FROM v WHERE version = 2 AND serial % 2 = 0""",
    "config_by_version": f"WITH {VERSIONS} SELECT serial, version, body FROM v WHERE version = 2",
    "voltage_panel": f"{VOLTAGES} SELECT time, vmon, name FROM r WHERE slot = '1' AND pw ORDER BY time",
    "voltage_latest": f"{VOLTAGES} SELECT time, vmon, slot, name FROM r WHERE slot IN ('0', '2') ORDER BY time DESC LIMIT 120",
    "first_hits": f"WITH {HITS_SQL} SELECT event_id, module, channel, energy, timestamp_ns FROM hits ORDER BY timestamp_ns, event_id LIMIT 50",
    "stop_tail": f"""WITH {HITS_SQL}, {BATCHES_SQL}, b AS (SELECT source_id, event_id // 1000 % 3 = 2 AND event_id % 1000 <> 999 AS out FROM batches)
        SELECT source_id, count(*) FILTER (WHERE NOT out) AS kept, count(*) FILTER (WHERE out) AS discarded FROM b GROUP BY 1""",
    "legacy_offsets": """WITH g AS (SELECT CAST(i // 5 AS INTEGER) AS module, CAST(i % 5 AS INTEGER) AS channel, i <> 7 AS other, i FROM range(20) r(i))
        SELECT module, channel, CAST(CASE WHEN other THEN 1 END AS INTEGER) AS ref_module, CAST(CASE WHEN other THEN 2 END AS INTEGER) AS ref_channel, (i - 7) * 12.5::DOUBLE AS offset_ns FROM g""",
}
