"""Run and settings documents as tables: a log of messages folded into runs, versions saved and restored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_documents(log: DataFrame) -> DataFrame:
    """One row a started run of a log ``run_number, seq, time_ms, kind, value``, kinds start, stats, error, note and end.

    Messages before the first start and after the first end that follows it change nothing. Stats are the last ones that count;
    those of the end message replace all others if they are given.
    """
    starts = log.filter("kind = 'start'").groupBy("run_number").agg(F.min(F.struct("seq", "time_ms")).alias("_start"))
    began = log.join(starts, "run_number").filter(F.col("seq") >= F.col("_start.seq"))
    ends = began.filter("kind = 'end'").groupBy("run_number").agg(F.min(F.struct("seq", "time_ms")).alias("_end"))
    active = began.join(ends, "run_number", "left").filter(F.col("_end").isNull() | (F.col("seq") <= F.col("_end.seq")))
    told = F.col("kind").isin("stats", "end") & F.col("value").isNotNull()
    runs = active.groupBy("run_number").agg(
        F.first("_start.time_ms").alias("start_ms"), F.first("_end.time_ms").alias("end_ms"), F.max_by(F.when(told, F.col("value")), F.when(told, F.col("seq"))).alias("total_events"),
        F.count_if(F.col("kind") == "error").alias("errors"), F.count_if(F.col("kind") == "note").alias("notes"),
    )
    status = F.when(F.col("end_ms").isNull(), "running").otherwise("completed")
    return runs.select("run_number", "start_ms", "end_ms", F.expr("(end_ms - start_ms) div 1000").alias("duration_s"), status.alias("status"), "total_events", "errors", "notes")


def saved(configs: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``configs`` with ``version`` and ``is_current`` after each row of ``fresh``, one a document, became its document's newest version."""
    top = configs.groupBy(*keys).agg(F.max("version").alias("_top"))
    version = (F.coalesce("_top", F.lit(0)) + 1).cast(dict(configs.dtypes)["version"])
    added = fresh.join(top, keys, "left").withColumn("version", version).withColumn("is_current", F.lit(True)).drop("_top")
    replaced = fresh.select(*keys, F.lit(True).alias("_replaced"))
    kept = configs.join(replaced, keys, "left").withColumn("is_current", F.col("is_current") & F.col("_replaced").isNull()).drop("_replaced")
    return kept.unionByName(added)


def restored(configs: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``configs`` after the versions named in ``wanted`` were saved again; they say so in ``description``."""
    again = configs.join(wanted, [*keys, "version"])
    return saved(configs, again.withColumn("description", F.concat(F.lit("Restored from version "), F.col("version").cast("string"))).drop("version"), keys)


def running_only(batches: DataFrame, running: Column, is_end: Column) -> DataFrame:
    """Marks batches that come outside a run as ``discarded``; end marks always pass. Nothing is dropped, so that the loss can be counted."""
    return batches.withColumn("discarded", ~running & ~is_end)


def recent(runs: DataFrame, limit: int = 25) -> DataFrame:
    """The latest runs by ``start_time``, then number; all of them for a limit of 0."""
    ordered = runs.orderBy(F.desc("start_time"), F.desc("run_number"))
    return ordered.limit(limit) if limit else ordered


def current(runs: DataFrame) -> DataFrame:
    """The run that is ``running``, of several the latest; no row without one."""
    return recent(runs.filter("status = 'running'"), 1)


def by_number(runs: DataFrame, number: int) -> DataFrame:
    """The run of a number, the latest of several."""
    return recent(runs.filter(F.col("run_number") == number), 1)


def last_info(runs: DataFrame, notes: DataFrame) -> DataFrame:
    """Of the latest run of each experiment: ``exp_name, run_number, comment``, empty if null, and ``notes``, structs ``time, text`` in order of time; none is an empty list."""
    last = runs.groupBy("exp_name").agg(F.max_by(F.struct("run_number", F.coalesce("comment", F.lit("")).alias("comment")), F.struct("start_time", "run_number")).alias("r")).select("exp_name", "r.*")
    listed = notes.join(last.select("run_number").distinct(), "run_number", "left_semi").groupBy("run_number").agg(F.array_sort(F.collect_list(F.struct("time", "text"))).alias("notes"))
    return last.join(listed, "run_number", "left").withColumn("notes", F.coalesce("notes", F.array().cast("array<struct<time:bigint,text:string>>"))).select("exp_name", "run_number", "comment", "notes")
