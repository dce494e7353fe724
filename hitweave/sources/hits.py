"""Hit, waveform and run views over the driver's tables, and literal dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Channel of each event type.
CHANNELS = {"click": 0, "view": 1, "purchase": 2, "signup": 3, "error": 4}
EPOCH_US = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector hits made of ``events``: module, channel, energies, time in ns as double, flag bits."""
    channel = F.coalesce(*[F.when(F.col("event_type") == name, F.lit(n)) for name, n in CHANNELS.items()])
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") % 4).cast("int").alias("module"),
        channel.cast("int").alias("channel"),
        F.least(F.lit(65535), F.floor(F.col("value") * 100)).cast("int").alias("energy"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)) * 1000).cast("double").alias("timestamp_ns"),
        F.expr("""CAST((CASE WHEN event_id % 100 = 0 THEN 1 ELSE 0 END) + (CASE WHEN event_id % 50 = 1 THEN 2 ELSE 0 END)
                  + (CASE WHEN event_id % 200 = 2 THEN 16 ELSE 0 END) AS BIGINT)""").alias("flags"),
    )
    short = F.expr("CAST(energy * (50 + k div 4) div 100 AS INT)")
    return rows.withColumn("energy_short", short).drop("k")


#: The same view in DuckDB SQL, as common table expression ``hits``.
HITS_SQL = """hits AS (
    SELECT event_id, CAST(user_id % 4 AS INTEGER) AS module,
           CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2
                WHEN 'signup' THEN 3 WHEN 'error' THEN 4 END AS INTEGER) AS channel,
           CAST(least(65535, floor(value * 100)) AS INTEGER) AS energy,
           CAST(CAST(least(65535, floor(value * 100)) AS BIGINT) * (50 + CAST(json_extract_string(props, '$.k') AS INTEGER) // 4) // 100 AS INTEGER) AS energy_short,
           CAST((epoch_us(ts) - 1704067200000000) * 1000 AS DOUBLE) AS timestamp_ns,
           CAST((CASE WHEN event_id % 100 = 0 THEN 1 ELSE 0 END) + (CASE WHEN event_id % 50 = 1 THEN 2 ELSE 0 END)
                + (CASE WHEN event_id % 200 = 2 THEN 16 ELSE 0 END) AS BIGINT) AS flags
    FROM events)"""


def channel_dim(spark: SparkSession) -> DataFrame:
    """Detector type, tags and cubic calibration of modules 0-3, channels 0-4; module 3 channel 4 is missing."""
    grid = spark.range(20).select((F.col("id") / 5).cast("int").alias("module"), (F.col("id") % 5).cast("int").alias("channel"))
    kind = F.element_at(F.array(*map(F.lit, ("Si", "Ge", "AC", "PMT", "Other"))), F.col("channel") + 1)
    tags = F.when(F.col("channel") == 0, F.array(F.lit("E"), F.lit("Si"))).when(F.col("channel") == 1, F.array(F.lit("dE"), F.lit("Si"))).otherwise(F.array(kind))
    rows = grid.select(
        "module", "channel", kind.alias("detector_type"), tags.alias("tags"),
        (F.col("module") * 0.5).alias("p0"), (0.25 + F.col("channel") * 0.125).alias("p1"),
        (F.col("module") * 2.0**-20).alias("p2"), F.lit(0.0).alias("p3"),
    )
    return rows.filter("NOT (module = 3 AND channel = 4)")


CHANNEL_DIM_SQL = """channel_dim AS (
    SELECT CAST(g // 5 AS INTEGER) AS module, CAST(g % 5 AS INTEGER) AS channel,
           ['Si', 'Ge', 'AC', 'PMT', 'Other'][g % 5 + 1] AS detector_type,
           CASE g % 5 WHEN 0 THEN ['E', 'Si'] WHEN 1 THEN ['dE', 'Si'] ELSE [['Si', 'Ge', 'AC', 'PMT', 'Other'][g % 5 + 1]] END AS tags,
           (g // 5) * CAST(0.5 AS DOUBLE) AS p0, CAST(0.25 AS DOUBLE) + (g % 5) * CAST(0.125 AS DOUBLE) AS p1,
           (g // 5) * pow(2.0, -20) AS p2, CAST(0 AS DOUBLE) AS p3
    FROM range(20) r(g) WHERE g <> 19)"""

#: ``(module, channel, ref_module, ref_channel, offset_ns)``; a null reference marks a root.
OFFSET_TREE = [
    (0, 0, None, None, 0.0), (0, 1, 0, 0, 12.5), (0, 2, 0, 1, -3.25), (0, 3, 0, 2, 4.0), (1, 0, 0, 0, 100.0),
    (1, 1, 1, 0, 7.5), (2, 0, None, None, 50.0), (2, 1, 2, 0, -20.0), (3, 0, 2, 1, 1.5),
]


def offset_tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OFFSET_TREE, "module int, channel int, ref_module int, ref_channel int, offset_ns double")


OFFSET_TREE_SQL = "offset_tree(module, channel, ref_module, ref_channel, offset_ns) AS (VALUES {})".format(
    ", ".join(
        "(CAST({} AS INTEGER), CAST({} AS INTEGER), CAST({} AS INTEGER), CAST({} AS INTEGER), CAST({} AS DOUBLE))".format(
            *("NULL" if v is None else v for v in row)
        )
        for row in OFFSET_TREE
    )
)


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pulses made of ``embeddings``: ``samples`` as ints, 2 ns apart, one of ten channels."""
    samples = F.transform("embedding", lambda x: F.floor(x.cast("double") * 8192 + 0.5).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("channel"), samples.alias("samples"), F.lit(2.0).alias("ns_per_sample"))


WAVEFORMS_SQL = """waveforms AS (
    SELECT vec_id, CAST(label AS INTEGER) AS channel, CAST(2 AS DOUBLE) AS ns_per_sample,
           list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 8192 + 0.5) AS INTEGER)) AS samples
    FROM embeddings)"""


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transport batches: one a hit, numbered a source, every 97th lost, numbering restarted at 5000."""
    rows = hits(spark, sf_dir).select(F.col("module").alias("source_id"), "event_id", "energy", "flags", (F.expr("(event_id div 4)")).alias("n"))
    return rows.filter("n % 97 <> 96").withColumn("sequence_number", F.expr("CASE WHEN n < 5000 THEN n ELSE n - 5000 END"))


BATCHES_SQL = """batches AS (
    SELECT module AS source_id, event_id, energy, flags, event_id // 4 AS n,
           CASE WHEN event_id // 4 < 5000 THEN event_id // 4 ELSE event_id // 4 - 5000 END AS sequence_number
    FROM hits WHERE (event_id // 4) % 97 <> 96)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run documents made of ``orders``."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("long").alias("run_number"), F.col("o_orderpriority").alias("exp_name"),
        F.col("o_orderdate").cast("date").alias("start_time"), F.col("o_custkey").cast("long").alias("total_events"),
    )


RUNS_SQL = """runs AS (
    SELECT CAST(o_orderkey AS BIGINT) AS run_number, o_orderpriority AS exp_name,
           CAST(o_orderdate AS DATE) AS start_time, CAST(o_custkey AS BIGINT) AS total_events FROM orders)"""
