"""Queries over recorded run files and raw read-outs that Spark first makes of the given tables, over histogram lists of both scopes and over forests of offsets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import shared_folder
from ..operators import forest
from ..operators.observed import Counters, kept_hits
from ..sources import aggregates, hist_specs, run_files
from ..sources.hits import HITS_SQL, WAVEFORMS_SQL, hits, table, waveforms

MAGIC = "RUNFILE1"


def recorded(rows: DataFrame, batch: int = 256) -> str:
    """The folder of run files that now hold the rows."""
    spark = rows.sparkSession
    run_files.register(spark)
    folder = f"{shared_folder(spark)}/recorded-{uuid.uuid4().hex}"
    rows.write.format("recorded").mode("append").option("magic", MAGIC).option("runNumber", 7).option("batchEvents", batch).save(folder)
    return folder


def recorded_hits(spark: SparkSession, d: str) -> DataFrame:
    """All hits through run files: six fields of each, read by runs of blocks."""
    folder = recorded(hits(spark, d).withColumn("source_id", F.col("module").cast("long")))
    return run_files.read(spark, folder, MAGIC.encode(), ["module", "channel", "energy", "energy_short", "timestamp_ns", "flags"], run_bytes=1 << 20)


def recorded_traces(spark: SparkSession, d: str) -> DataFrame:
    """All traces through run files in the wide form: every second a hit without one; the trace, its fields and whether there is one."""
    rows = waveforms(spark, d).select(
        F.lit(3).alias("module"), "channel", (F.col("vec_id") % 65536).cast("int").alias("energy"), F.lit(0).alias("energy_short"),
        F.col("vec_id").cast("double").alias("timestamp_ns"), F.when(F.col("vec_id") % 2 == 0, F.col("samples")).alias("analog_probe1"),
        F.when(F.col("vec_id") % 2 == 0, F.transform("samples", lambda x: (x > 0).cast("int"))).alias("digital_probe2"),
        F.when(F.col("vec_id") % 2 == 0, F.col("ns_per_sample")).alias("ns_per_sample"),
    )
    read = ["channel", "timestamp_ns", "has_waveform", "analog_probe1", "analog_probe2", "digital_probe2", "ns_per_sample"]
    found = run_files.read(spark, recorded(rows, 64), MAGIC.encode(), read, run_bytes=1 << 20)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    return found.select(
        F.col("timestamp_ns").cast("long").alias("vec_id"), "channel", "has_waveform", text("analog_probe1").alias("trace"),
        text("digital_probe2").alias("above"), F.size("analog_probe2").cast("long").alias("other"), "ns_per_sample",
    )


def aggregate_hits(spark: SparkSession, d: str) -> DataFrame:
    """All hits through 64-bit aggregates of a hundred: every tenth in one word with the event's number as time, the others in two."""
    word = lambda shift, c: F.shiftleft(c.cast("long"), shift)
    e, channel, energy = F.col("event_id"), F.col("channel"), F.col("energy")
    alone = e % 10 == 0
    last = F.lit(-(1 << 63))
    one = last.bitwiseOR(word(56, channel)).bitwiseOR(word(16, e.bitwiseAND(F.lit(0xFFFFFFFF)))).bitwiseOR(energy.cast("long"))
    first = word(56, channel).bitwiseOR(F.expr("cast(timestamp_ns as bigint) div 16384"))
    rest = (word(50, F.col("flags")), word(26, F.col("energy_short")), word(16, energy % 1024), energy.cast("long"))
    then = last
    for part in rest:
        then = then.bitwiseOR(part)
    spelt = F.when(alone, F.lpad(F.hex(one), 16, "0")).otherwise(F.concat(F.lpad(F.hex(first), 16, "0"), F.lpad(F.hex(then), 16, "0")))
    rows = hits(spark, d).select("module", F.expr("event_id div 400").alias("block"), "event_id", spelt.alias("spelt"))
    body = rows.groupBy("module", "block").agg(F.array_join(F.array_sort(F.collect_list(F.struct("event_id", "spelt")))["spelt"], "").alias("body"))
    head = F.concat(F.lit("20000000"), F.lpad(F.hex((F.length("body") / 16).cast("long") + 1), 8, "0"))
    raw = body.select("module", F.unhex(F.concat(head, "body")).alias("content"))
    return aggregates.decode(raw, "charge64", ["module"]).drop("place")


#: A histogram list of both scopes as users write it.
LIST = """{"histograms": [
    {"name": "all", "type": "TH1D", "fill": "energy", "bins": 64, "min": 0, "max": 65536},
    {"name": "third", "type": "TH1D", "x": "energy_short", "xbins": 50, "xmin": 1000, "xmax": 20000, "channel": 2},
    {"name": "shape", "type": "TH2D", "x": "energy", "xbins": 20, "xmin": 0, "xmax": 40000, "y": "psd", "ybins": 8, "ymin": 0, "ymax": 1, "energy_range": [500, 35000]},
    {"name": "gap1", "type": "TH1D", "x": "dt1", "xbins": 40, "xmin": -600e9, "xmax": 600e9, "gamma_energy_range": [5000, 45000]},
    {"name": "gap2", "type": "TH1D", "x": "dt2", "xbins": 24, "xmin": -600e9, "xmax": 600e9, "thgem2_energy_range": [1000, 30000]},
    {"name": "gammas", "type": "TH1D", "x": "gamma_energy", "xbins": 16, "xmin": 0, "xmax": 65536, "thgem1_energy_range": [0, 20000]},
    {"name": "both", "type": "TH2D", "x": "thgem1_energy", "xbins": 8, "xmin": 0, "xmax": 65536, "y": "thgem2_energy", "ybins": 8, "ymin": 0, "ymax": 65536}]}"""
WINDOW_NS = 600e9


def coincidence_specs(spark: SparkSession, d: str) -> DataFrame:
    """All histograms of a list: energies, and time differences of channel 0 to its nearest hits of channels 1 and 2."""
    specs, errors = hist_specs.compile_list(LIST)
    if errors:
        raise ValueError("; ".join(errors))
    return hist_specs.fill(hits(spark, d), specs, 0, (1, 2), WINDOW_NS)


def offset_forest(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of customers along chains of up to 500, some broken off, some in circles, some listed twice."""
    key = F.col("c_custkey").cast("long")
    parent = F.when(key % 500 == 3, None).when(key % 700 == 11, -key).when(key % 1000 == 990, key + 5).otherwise(key - 1)
    rows = table(spark, d, "customer").select(key.alias("node"), parent.alias("parent"), ((key % 16) * 0.25).alias("ns"))
    return forest.resolve(rows.unionByName(rows.filter("node % 900 = 17")), "node", "parent", "ns")


def observed_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of hits read, outside of runs, below threshold and kept, taken while the kept ones are written."""
    counters = Counters()
    running = ~((F.expr("event_id div 1000") % 3 == 2) & (F.col("event_id") % 1000 != 999))
    kept = kept_hits(hits(spark, d), counters, 2000 + 500 * F.col("channel"), running, [0, 1, 2, 3])
    kept.write.parquet(f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}")
    return counters.table(kept)


QUERIES = {f.__name__: f for f in (recorded_hits, recorded_traces, aggregate_hits, coincidence_specs, offset_forest, observed_counters)}


def _slot(v: str, low: float, high: float, bins: int) -> str:
    f = f"CAST(CAST({v} AS DOUBLE) AS FLOAT)"
    return f"""CASE WHEN {f} < CAST({low} AS FLOAT) THEN -1 WHEN {f} >= CAST({high} AS FLOAT) THEN {bins}
        ELSE least(CAST(trunc(({f} - CAST({low} AS FLOAT)) / CAST({(high - low) / bins!r} AS FLOAT)) AS INTEGER), {bins}) END"""


def _one(name: str, rows: str, axes: list[tuple], where: str = "true") -> str:
    at = _slot(*axes[0])
    if len(axes) == 2:
        y = _slot(*axes[1])
        at = f"CASE WHEN ({at}) BETWEEN 0 AND {axes[0][3] - 1} AND ({y}) BETWEEN 0 AND {axes[1][3] - 1} THEN ({y}) * {axes[0][3]} + ({at}) ELSE -1 END"
    full = " AND ".join(f"({a[0]}) IS NOT NULL" for a in axes)
    return f"SELECT '{name}' AS name, CAST({at} AS INTEGER) AS bin, count(*) AS counts FROM {rows} WHERE {full} AND {where} GROUP BY ALL"


def _partner(k: int) -> str:
    return f"""n{k} AS (SELECT a.event_id, b.timestamp_ns - a.timestamp_ns AS dt{k}, b.energy AS thgem{k}_energy,
            row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.timestamp_ns - a.timestamp_ns), b.timestamp_ns, b.event_id) AS rk
            FROM hits a JOIN hits b ON b.channel = {k} AND b.timestamp_ns BETWEEN a.timestamp_ns - 600e9::DOUBLE AND a.timestamp_ns + 600e9::DOUBLE WHERE a.channel = 0)"""


ORACLE_SQL = {
    "recorded_hits": f"WITH {HITS_SQL} SELECT module, channel, energy, energy_short, timestamp_ns, flags FROM hits",
    "recorded_traces": f"""WITH {WAVEFORMS_SQL}
        SELECT CAST(vec_id AS BIGINT) AS vec_id, channel, vec_id % 2 = 0 AS has_waveform, CASE WHEN vec_id % 2 = 0 THEN array_to_string(samples, ' ') END AS trace,
               CASE WHEN vec_id % 2 = 0 THEN array_to_string(list_transform(samples, lambda x: CAST(x > 0 AS INTEGER)), ' ') END AS above,
               CAST(CASE WHEN vec_id % 2 = 0 THEN 0 END AS BIGINT) AS other, CASE WHEN vec_id % 2 = 0 THEN ns_per_sample END AS ns_per_sample
        FROM waveforms""",
    "aggregate_hits": f"""WITH {HITS_SQL}, h AS (SELECT *, event_id % 10 = 0 AS alone FROM hits)
        SELECT module, channel, energy, CASE WHEN alone THEN 0 ELSE energy_short END AS energy_short, CASE WHEN alone THEN 0 ELSE energy % 1024 END AS fine_time,
               CASE WHEN alone THEN event_id * 2.0::DOUBLE ELSE (CAST(timestamp_ns AS BIGINT) // 16384) * 2.0::DOUBLE + (energy % 1024) / 1024.0::DOUBLE * 2.0::DOUBLE END AS timestamp_ns,
               CASE WHEN alone THEN 0 ELSE flags END AS flags
        FROM h""",
    "coincidence_specs": f"""WITH {HITS_SQL}, p AS (SELECT *, CASE WHEN energy > 0 THEN CAST(energy - energy_short AS FLOAT) / CAST(energy AS FLOAT) END AS psd FROM hits), {_partner(1)}, {_partner(2)},
        c AS (SELECT h.energy AS gamma_energy, dt1, thgem1_energy, dt2, thgem2_energy FROM hits h LEFT JOIN n1 ON n1.event_id = h.event_id AND n1.rk = 1
              LEFT JOIN n2 ON n2.event_id = h.event_id AND n2.rk = 1 WHERE h.channel = 0)
        {_one("all", "p", [("energy", 0.0, 65536.0, 64)])} UNION ALL {_one("third", "p", [("energy_short", 1000.0, 20000.0, 50)], "channel = 2")}
        UNION ALL {_one("shape", "p", [("energy", 0.0, 40000.0, 20), ("psd", 0.0, 1.0, 8)], "energy BETWEEN 500 AND 35000")}
        UNION ALL {_one("gap1", "c", [("dt1", -600e9, 600e9, 40)], "gamma_energy BETWEEN 5000 AND 45000")} UNION ALL {_one("gap2", "c", [("dt2", -600e9, 600e9, 24)], "thgem2_energy BETWEEN 1000 AND 30000")}
        UNION ALL {_one("gammas", "c", [("gamma_energy", 0.0, 65536.0, 16)], "thgem1_energy BETWEEN 0 AND 20000")}
        UNION ALL {_one("both", "c", [("thgem1_energy", 0.0, 65536.0, 8), ("thgem2_energy", 0.0, 65536.0, 8)])}""",
    "offset_forest": """
        WITH RECURSIVE e AS (
            SELECT CAST(c_custkey AS BIGINT) AS node, c_custkey % 16 * 0.25::DOUBLE AS ns, c_custkey % 900 = 17 AS twice,
                   CASE WHEN c_custkey % 500 = 3 THEN NULL WHEN c_custkey % 700 = 11 THEN -c_custkey WHEN c_custkey % 1000 = 990 THEN c_custkey + 5 ELSE c_custkey - 1 END AS parent
            FROM customer),
        s AS (SELECT *, CASE WHEN twice THEN 'double' WHEN parent IS NOT NULL AND parent NOT IN (SELECT node FROM e) THEN 'dangling' END AS bad FROM e),
        w AS (
            SELECT node, node AS at, ns AS total, CAST(0 AS BIGINT) AS depth FROM s
            UNION ALL SELECT w.node, p.node, w.total + p.ns, w.depth + 1 FROM w JOIN s c ON c.node = w.at AND c.bad IS NULL JOIN s p ON p.node = c.parent WHERE w.depth < 1100),
        t AS (SELECT w.node, w.at, w.total, w.depth, s.bad FROM w JOIN s ON s.node = w.at WHERE s.bad IS NOT NULL OR s.parent IS NULL)
        SELECT e.node, CASE WHEN t.bad IS NULL THEN t.at END AS root, CASE WHEN t.bad IS NULL THEN t.total END AS "offset", CASE WHEN t.bad IS NULL THEN t.depth END AS depth,
               CASE WHEN t.node IS NULL THEN 'cycle' WHEN t.bad IS NULL THEN NULL WHEN t.at = t.node THEN t.bad ELSE 'above' END AS fault
        FROM e LEFT JOIN t ON t.node = e.node""",
    "observed_counters": f"""WITH {HITS_SQL}, r AS (SELECT *, NOT (event_id // 1000 % 3 = 2 AND event_id % 1000 <> 999) AS running, energy >= 2000 + 500 * channel AS high FROM hits),
        c AS (SELECT count(*) AS a, count(*) FILTER (NOT running) AS b, {", ".join(f"count(*) FILTER (module = {m}) AS s{m}" for m in range(4))}, count(*) FILTER (running) AS d,
                     count(*) FILTER (running AND NOT high) AS e, count(*) FILTER (running AND high) AS f, sum(energy) FILTER (running AND high) AS g,
                     max(floor(timestamp_ns / 1e6)) FILTER (running AND high) AS h FROM r)
        SELECT * FROM (SELECT unnest(['read', 'read', 'read', 'read', 'read', 'read', 'running', 'running', 'kept', 'kept', 'kept']) AS point,
            unnest(['rows', 'outside_runs', 'source_0', 'source_1', 'source_2', 'source_3', 'rows', 'below_threshold', 'rows', 'energy', 'latest_ms']) AS counter,
            unnest([CAST(a AS BIGINT), b, s0, s1, s2, s3, d, e, f, CAST(g AS BIGINT), CAST(h AS BIGINT)]) AS value FROM c)""",
}
