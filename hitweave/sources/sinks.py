"""Writers of hits, built events, histograms and metric lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_hits(hits: DataFrame, path: str, run_column: str = "run_number", rows_per_file: int = 5_000_000) -> None:
    """Appends hits to a folder a run; files end after ``rows_per_file`` rows and are never overwritten."""
    hits.write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy(run_column).parquet(path)


def event_columns(events: DataFrame, counters: list[str] | None = None) -> DataFrame:
    """Built events with one array column a hit field, and one LONG a counter, 0 where it is missing."""
    fields = {"mod": "module", "ch": "channel", "energy": "energy", "energy_short": "energy_short", "rel_time": "relative_time", "with_ac": "with_ac"}
    arrays = [F.col(f"hits.{f}").alias(name) for name, f in fields.items()]
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counters or []]
    return events.select("event_no", "trigger_time", "trigger_module", "trigger_channel", "multiplicity", *arrays, *counts)


def write_events(events: DataFrame, path: str, counters: list[str] | None = None, events_per_file: int = 1_000_000) -> None:
    event_columns(events, counters).write.mode("append").option("maxRecordsPerFile", events_per_file).parquet(path)


#: Fixed values of the dump format: fields of a record, little-endian and without gaps.
RECORD = {"module": "u1", "channel": "u1", "energy": "<u2", "energy_short": "<u2", "flags": "<u8", "timestamp_ns": "<f8"}


def flat_records(hits: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``record``, the 22 bytes of each hit."""
    names, layout = list(RECORD), np.dtype(list(RECORD.items()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            packed = np.empty(len(pdf), layout)
            for n in names:
                packed[n] = pdf[n].to_numpy()
            data, size = packed.tobytes(), layout.itemsize
            yield pdf[keep].assign(record=[data[i : i + size] for i in range(0, len(data), size)])

    types = dict(hits.dtypes)
    return hits.select(*dict.fromkeys([*keep, *names])).mapInPandas(run, ", ".join([*(f"`{k}` {types[k]}" for k in keep), "record binary"]))


def histogram_rows(hist: DataFrame, keys: list[str], low: float, width: float) -> DataFrame:
    """One row a key with bin centres and counts in order, entries and the fullest bin's centre; as many bins as were filled."""
    centre = F.lit(low) + (F.col("bin") + 0.5) * F.lit(width)
    rows = hist.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(centre.alias("x"), "counts"))).alias("b"), F.sum("counts").alias("entries"),
        F.max(F.struct("counts", centre.alias("x"))).alias("p"),
    )
    return rows.select(*keys, F.col("b.x").alias("centres"), F.col("b.counts").alias("counts"), "entries", F.col("p.x").alias("peak"))


def metric_lines(rows: DataFrame, name: str, tags: list[str], value: str) -> DataFrame:
    """Lines ``name,tag=value value=ni`` of the rows that counted anything."""
    parts = [F.lit(name)] + [F.concat(F.lit(f",{t}="), F.col(t).cast("string")) for t in tags]
    return rows.filter(F.col(value) > 0).select(F.concat(*parts, F.lit(" count="), F.col(value).cast("string"), F.lit("i")).alias("line"))


def publish(stream: DataFrame, checkpoint: str, send: Callable[[DataFrame, int], None]):
    """Runs ``send(batch, number)`` for each micro-batch; numbers are unique, and a batch is repeated under its number after a failure."""
    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).start()
