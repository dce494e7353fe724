"""Live histograms and the state of runs over a stream of messages, kept as tables a micro-batch.

Messages are rows with ``seq`` (their order), ``run_number``, ``source_id``, ``kind`` (``start``, ``data``, ``end`` or ``heartbeat``) and, for data, the columns of a hit. Every micro-batch is
aggregated by Spark and added to the tables of the one before, which hold a row a bin and a row a source; a micro-batch that is played again after a
failure starts from the same tables and writes the same ones.

A start clears its run: what was said before it under that number counts no more. A run is closed once every source that sent data since its start has ended; ends without data before them
are stale and pass. Heartbeats say nothing. The histogram list is read anew for each micro-batch: a list without errors replaces the one in use, and
histograms that are new or changed begin empty; a list with errors changes nothing, and its errors can be asked for.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import shared_folder
from ..sources.hist_specs import Spec, compile_list, fill_scope

COUNTS = "run_number long, name string, version string, bin int, counts long"
SOURCES = "run_number long, source_id long, first_data long, last_end long, started long"


def version(spec: Spec) -> str:
    """Changes with anything that changes what a histogram counts."""
    return hashlib.sha256(repr(spec).encode()).hexdigest()[:16]


class LiveRuns:
    """``stream.writeStream.foreachBatch(live.take)``; :meth:`histograms` and :meth:`runs` read the tables after the last micro-batch.

    ``read_list`` returns the histogram list as text; only specs of the hit scope are filled. A driver that goes on after another gives ``folder`` and ``last``, its last micro-batch.
    """

    def __init__(self, spark: SparkSession, read_list: Callable[[], str], folder: str | None = None, last: int | None = None) -> None:
        self.spark, self.read_list = spark, read_list
        self.folder = folder or f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
        self.specs: list[Spec] = []
        self.errors: list[str] = []
        self.last = last

    def _table(self, name: str, schema: str, batch: int | None) -> DataFrame:
        if batch is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/batch={batch}")

    def refresh(self) -> None:
        """Reads the list; on any error the specs in use stay."""
        specs, self.errors = compile_list(self.read_list())
        self.errors += [f"{s.name}: only hits are filled live" for s in specs if s.scope != "hit"]
        if not self.errors:
            self.specs = specs

    def take(self, messages: DataFrame, batch: int) -> None:
        self.refresh()
        before = self.last if self.last is None or self.last < batch else None if batch == 0 else batch - 1
        told = messages.filter("kind != 'heartbeat'").persist()
        starts = told.filter("kind = 'start'").groupBy("run_number").agg(F.max("seq").alias("begun"))  # a row a run that starts here
        fresh = told.join(F.broadcast(starts), "run_number", "left").filter("kind != 'start' AND (begun IS NULL OR seq > begun)")

        counts = self._table("counts", COUNTS, before).join(F.broadcast(starts), "run_number", "left_anti")
        wanted = [(s.name, version(s)) for s in self.specs]
        if self.specs:
            data = fresh.filter("kind = 'data'")
            psd = F.when(F.col("energy") > 0, (F.col("energy") - F.col("energy_short")).cast("float") / F.col("energy").cast("float"))
            names = F.create_map(*[F.lit(x) for pair in wanted for x in pair])
            made = fill_scope(data.withColumn("psd", psd), self.specs, ["run_number"]).withColumn("version", F.element_at(names, F.col("name")))
            still = F.concat_ws("/", "name", "version").isin([f"{n}/{v}" for n, v in wanted])
            counts = counts.filter(still).unionByName(made.select(*counts.columns))
        else:
            counts = counts.limit(0)
        added = counts.groupBy("run_number", "name", "version", "bin").agg(F.sum("counts").alias("counts"))
        added.select("run_number", "name", "version", "bin", "counts").write.mode("overwrite").parquet(f"{self.folder}/counts/batch={batch}")

        old = self._table("sources", SOURCES, before).join(F.broadcast(starts), "run_number", "left_anti")
        now = fresh.groupBy("run_number", "source_id").agg(
            F.min(F.when(F.col("kind") == "data", F.col("seq"))).alias("first_data"), F.max(F.when(F.col("kind") == "end", F.col("seq"))).alias("last_end"), F.max("begun").alias("started"))
        merged = old.unionByName(now).groupBy("run_number", "source_id").agg(F.min("first_data").alias("first_data"), F.max("last_end").alias("last_end"), F.max("started").alias("started"))
        merged.write.mode("overwrite").parquet(f"{self.folder}/sources/batch={batch}")
        told.unpersist()
        self.last = batch

    def histograms(self, run_number: int) -> DataFrame:
        """``name, bin, counts`` of a run."""
        return self._table("counts", COUNTS, self.last).filter(F.col("run_number") == run_number).select("name", "bin", "counts")

    def runs(self) -> DataFrame:
        """``run_number, sources, ended, closed`` of every run with data; an end before the run's first data is stale."""
        rows = self._table("sources", SOURCES, self.last)
        first = rows.groupBy("run_number").agg(F.min("first_data").alias("opened")).filter("opened IS NOT NULL")
        met = rows.join(first, "run_number").filter("first_data IS NOT NULL")
        ended = F.coalesce(F.col("last_end") > F.col("opened"), F.lit(False))
        return met.groupBy("run_number").agg(F.count("*").alias("sources"), F.count_if(ended).alias("ended"), F.bool_and(ended).alias("closed"))
