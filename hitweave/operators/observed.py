"""Counters taken while a result is written, in the same pass over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Counters:
    """Watches rows at any number of points of a plan; the counts are there once the plan has been written, and cost no pass of their own.

    A point that two branches of one plan share is counted in each; tasks that are run again count once, when they succeed. Before anything has run, asking waits.
    """

    def __init__(self) -> None:
        self.points: dict[str, Observation] = {}

    def watch(self, rows: DataFrame, point: str, **counts: Column) -> DataFrame:
        """The same rows, counted as ``rows`` and by the aggregates ``counts``."""
        if point in self.points:
            raise ValueError(f"{point} is watched already")
        self.points[point] = Observation(point)
        return rows.observe(self.points[point], F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()])

    def values(self) -> dict[str, dict]:
        """By point, the counts by name."""
        return {point: dict(seen.get) for point, seen in self.points.items()}

    def table(self, rows: DataFrame) -> DataFrame:
        """``point, counter, value`` in the session of ``rows``; null where an aggregate had no rows."""
        found = [(p, n, None if v is None else int(v)) for p, counts in self.values().items() for n, v in counts.items()]
        return rows.sparkSession.createDataFrame(found, "point string, counter string, value long")


def kept_hits(hits: DataFrame, counters: Counters, threshold: Column, running: Column, sources: list[int]) -> DataFrame:
    """Hits of running runs above their threshold, counted before, between and after; ``sources`` are counted one by one."""
    by_source = {f"source_{s}": F.count_if(F.col("module") == s) for s in sources}
    read = counters.watch(hits, "read", outside_runs=F.count_if(~running), **by_source)
    inside = counters.watch(read.filter(running), "running", below_threshold=F.count_if(F.col("energy") < threshold))
    return counters.watch(inside.filter(F.col("energy") >= threshold), "kept", energy=F.sum("energy"), latest_ms=F.max(F.floor(F.col("timestamp_ns") / 1e6)))
