"""Structured Streaming over hit streams.

Times stay doubles in ns; a timestamp column of whole microseconds rides along
for watermarks only. Nothing is dropped silently: late hits come out marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SORTED = "source_id long, event_id long, timestamp_ns double, late boolean"


def with_event_time(hits: DataFrame, delay: str) -> DataFrame:
    """Adds ``event_time`` in microseconds and its watermark."""
    return hits.withColumn("event_time", F.timestamp_micros(F.floor(F.col("timestamp_ns") / 1000).cast("long"))).withWatermark("event_time", delay)


def live_histogram(hits: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Running energy histograms by module and channel, for complete or update mode."""
    width = (high - low) / bins
    at = F.when(F.col("energy") < low, -1).when(F.col("energy") >= high, bins).otherwise(F.floor((F.col("energy") - F.lit(low)) / F.lit(width)).cast("int"))
    return hits.withColumn("bin", at).groupBy("module", "channel", "bin").agg(F.count("*").alias("counts"))


def windowed_counts(hits: DataFrame, delay: str, span: str) -> DataFrame:
    """Counts by module in tumbling windows, final once the watermark has passed."""
    return with_event_time(hits, delay).groupBy(F.window("event_time", span), "module").agg(F.count("*").alias("hits")).select("window.start", "module", "hits")


def time_sorted(hits: DataFrame, delay_ns: float, keys: str = "source_id") -> DataFrame:
    """Hits of each source in time order: released once ``delay_ns`` older than the newest; those already passed come out late.

    State is the buffer of one source and its newest time. Ids and times only, and the tail stays held;
    :func:`stateful.time_sorted` keeps all columns and ends with the run.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, released, ids, times = state.get if state.exists else (float("-inf"), float("-inf"), [], [])
        pdf = pd.concat([*frames, pd.DataFrame({"event_id": list(ids), "timestamp_ns": list(times)})])
        newest = max(newest, pdf["timestamp_ns"].max())
        late = pdf["timestamp_ns"] < released
        ready = (pdf["timestamp_ns"] <= newest - delay_ns) | late
        out = pdf[ready].assign(source_id=key[0], late=late[ready]).sort_values(["timestamp_ns", "event_id"])
        rest = pdf[~ready]
        state.update((float(newest), float(max(released, newest - delay_ns)), [int(i) for i in rest["event_id"]], [float(t) for t in rest["timestamp_ns"]]))
        yield out[["source_id", "event_id", "timestamp_ns", "late"]]

    schema = "newest double, released double, ids array<long>, times array<double>"
    return hits.groupBy(keys).applyInPandasWithState(run, SORTED, schema, "append", GroupStateTimeout.NoTimeout)


CHUNKS = "source_id long, chunk long, core_start double, core_end double, event_id long, timestamp_ns double, core boolean, late boolean"


def next_chunk(held: pd.DataFrame, core_start: float, horizon_ns: float, lookback_ns: float, ended: bool) -> tuple[pd.DataFrame | None, pd.DataFrame, float]:
    """The chunk that can be given out, or None, the hits that are kept, and where the next core starts.

    A core ends ``horizon_ns`` before the newest hit, at the end of the data at infinity; hits from ``lookback_ns`` before
    that on are kept as context of the next chunk, in whose core the earlier ones are not. While the hits do not span more than the horizon, all are kept.
    """
    held = held.sort_values(["timestamp_ns", "event_id"])
    times = held["timestamp_ns"]
    core_end = float("inf") if ended else (times.max() - horizon_ns if len(held) else float("-inf"))
    if not len(held) or core_end <= times.iloc[0]:
        return None, held, core_start
    chunk = held.assign(core_start=core_start, core_end=core_end, core=(times >= core_start) & (times < core_end))
    return chunk, held[times >= core_end - lookback_ns], core_end


def safe_chunks(hits: DataFrame, horizon_ns: float, lookback_ns: float, keys: str = "source_id") -> DataFrame:
    """Sorted chunks of each source from rows with ``end``, true on a row that closes the source's run and is no hit itself.

    Events are built in a chunk from all its hits, and those whose first trigger is a ``core`` hit count: each hit is in one core, unless
    it comes below it and so ``late``. State is what lies within horizon and look-back, and starts anew after an end.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, start, ids, times = state.get if state.exists else (0, float("-inf"), [], [])
        pdf = pd.concat(list(frames))
        ended, fresh = bool(pdf["end"].any()), pdf[~pdf["end"].astype(bool)]
        carried = pd.DataFrame({"event_id": list(ids), "timestamp_ns": list(times), "late": False})
        fresh = fresh[["event_id", "timestamp_ns"]].assign(late=fresh["timestamp_ns"] < start)
        chunk, rest, start = next_chunk(fresh if carried.empty else pd.concat([carried, fresh]), start, horizon_ns, lookback_ns, ended)
        if ended:
            state.remove()
        else:
            state.update((number + (chunk is not None), float(start), [int(i) for i in rest["event_id"]], [float(t) for t in rest["timestamp_ns"]]))
        if chunk is not None:
            yield chunk.assign(source_id=key[0], chunk=number)[[c.split()[0] for c in CHUNKS.split(", ")]]

    schema = "number long, core_start double, ids array<long>, times array<double>"
    return hits.groupBy(keys).applyInPandasWithState(run, CHUNKS, schema, "append", GroupStateTimeout.NoTimeout)


def nearest_in_stream(left: DataFrame, right: DataFrame, window_ns: float, delay: str) -> DataFrame:
    """Pairs of two watermarked streams within ``window_ns``, by an interval join. All of them: :func:`stateful.nearest_in_stream` picks the nearest in the stream."""
    margin = f"{int(window_ns // 1000) + 1} microseconds"
    a = with_event_time(left, delay).select(F.col("event_id").alias("left_id"), F.col("timestamp_ns").alias("left_ns"), F.col("event_time").alias("left_time"))
    b = with_event_time(right, delay).select(F.col("event_id").alias("right_id"), F.col("timestamp_ns").alias("right_ns"), F.col("event_time").alias("right_time"))
    close = F.expr(f"right_time BETWEEN left_time - INTERVAL {margin} AND left_time + INTERVAL {margin}")
    return a.join(b, close & (F.abs(F.col("right_ns") - F.col("left_ns")) <= F.lit(float(window_ns))))


def end_of_streams(messages: DataFrame) -> DataFrame:
    """Per run: sources that sent data, and those of them that ended; the run is over once they are equal."""
    marks = messages.filter("kind != 'heartbeat'").groupBy("run_number").agg(
        F.collect_set(F.when(F.col("kind") == "data", F.col("source_id"))).alias("sources"), F.collect_set(F.when(F.col("kind") == "end", F.col("source_id"))).alias("ends"))
    return marks.select("run_number", F.size("sources").alias("sources"), F.size(F.array_intersect("sources", "ends")).alias("ended"),
                        (F.size(F.array_except("sources", "ends")) == 0).alias("closed"))
