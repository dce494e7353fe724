"""Stateful streams with typed state: hits in time order, and the nearest partner of each hit, equal to the batch results for any cut into micro-batches.

Both keep whole rows in list state, keyed by run or source, and both know a row with ``end`` true: it closes the key's run, is no hit itself, and lets
everything out that is still held; after it the key starts anew. The state store has to be RocksDB's, see :func:`use_rocksdb`.

Defined results: rows without a time are passed over; a key without an end mark keeps its tail until its ``idle_ms`` have gone by without rows, if given; rows of a
micro-batch with an end mark all belong to the run that it closes, those after it to the next; ties of time keep the order of all their columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MINUS = float("-inf")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def in_order(rows: pd.DataFrame, time: str) -> pd.DataFrame:
    """By time, ties by all other columns that can be compared, so that the order does not depend on arrival."""
    plain = [c for c in rows.columns if c != time and not rows[c].map(lambda v: isinstance(v, (list, dict, np.ndarray))).any()]
    return rows.sort_values([time, *plain], kind="stable", na_position="first", ignore_index=True)


def plain(whole: bool, value: object) -> object:
    """A value as state takes it: null for what pandas has instead, integers where a null beside them made them something else."""
    if value is None or value is pd.NA or value != value:
        return None
    return int(value) if whole else value.item() if isinstance(value, np.generic) else value


class Held(StatefulProcessor):
    """Rows and a few numbers that are kept a key, and the end and idle marks; what happens with them is told by ``step``."""

    #: DDL of the numbers and what they are at the beginning.
    marks, fresh = "newest double, released double, position long", (MINUS, MINUS, 0)

    def __init__(self, kept: T.StructType, out: list[str], key: str, end: str | None, idle_ms: int | None) -> None:
        self.kept, self.out, self.key, self.end, self.idle_ms = kept, out, key, end, idle_ms
        self.whole = [isinstance(f.dataType, T.IntegralType) for f in kept.fields]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.kept)
        self.mark = handle.getValueState("mark", self.marks)

    def step(self, held: pd.DataFrame, mark: tuple, fresh: pd.DataFrame, ended: bool) -> tuple[pd.DataFrame, pd.DataFrame, tuple]:
        """What comes out, what is held on, and the numbers after."""
        raise NotImplementedError

    def _turn(self, key: tuple, fresh: pd.DataFrame, ended: bool) -> pd.DataFrame:
        names = self.kept.names
        held = pd.DataFrame(list(self.rows.get()) if self.rows.exists() else [], columns=names)
        mark = tuple(self.mark.get()) if self.mark.exists() else self.fresh
        out, held, mark = self.step(held, mark, fresh[names], ended)
        if ended or not len(held) and mark == self.fresh:
            self.rows.clear()
            self.mark.clear()
        else:
            self.rows.put([tuple(map(plain, self.whole, r)) for r in held.itertuples(index=False, name=None)])
            self.mark.update(mark)
        return out.assign(**{self.key: key[0]})[self.out]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows), ignore_index=True)
        ends = fresh[self.end].fillna(False).astype(bool) if self.end else pd.Series(False, index=fresh.index)
        hits = fresh[~ends.to_numpy()].copy()
        for name, whole in zip(self.kept.names, self.whole):
            if whole:
                hits[name] = pd.Series([plain(True, v) for v in hits[name]], index=hits.index, dtype=object)
        yield self._turn(key, hits, bool(ends.any()))
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._turn(key, pd.DataFrame(columns=self.kept.names), True)

    def close(self) -> None:
        pass


def sort_step(held: pd.DataFrame, mark: tuple, fresh: pd.DataFrame, ended: bool, time: str, delay: float) -> tuple[pd.DataFrame, pd.DataFrame, tuple]:
    """Rows at least ``delay`` older than the newest, in order with their ``position``; those below what was released before are ``late`` and have none."""
    newest, released, position = mark
    fresh = fresh[fresh[time].notna()]
    late = fresh[fresh[time] < released]
    rows = [f for f in (held, fresh[fresh[time] >= released]) if len(f)]
    every = in_order(pd.concat(rows, ignore_index=True), time) if rows else held
    newest = max([newest, *fresh[time]]) if len(fresh) else newest
    until = float("inf") if ended else newest - delay
    ready = every[time] < until  # a row at the border may still get company of its own time
    out = every[ready].assign(late=False, position=np.arange(position, position + int(ready.sum())))
    passed = in_order(late, time).assign(late=True, position=None) if len(late) else None
    out = pd.concat([passed, out], ignore_index=True) if passed is not None and len(out) else passed if passed is not None else out
    return out, every[~ready], (float(newest), float(max(released, until)), position + int(ready.sum()))


def time_sorted(hits: DataFrame, delay_ns: float, key: str = "source_id", time: str = "timestamp_ns", end: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """All columns of the hits of each key in time order, with ``late`` and ``position``, which are those of a sort of the whole key where disorder stays within ``delay_ns``.

    A late hit has no position: it comes after its place was given out, and serves as context only.
    """
    kept = T.StructType([f for f in hits.schema.fields if f.name not in (key, end)])
    out = T.StructType([hits.schema[key], *kept.fields, T.StructField("late", T.BooleanType()), T.StructField("position", T.LongType())])

    class Sorted(Held):
        def step(self, held, mark, fresh, ended):
            return sort_step(held, mark, fresh, ended, time, delay_ns)

    return _run(hits, key, Sorted(kept, out.names, key, end, idle_ms), out, idle_ms)


def nearest_step(held: pd.DataFrame, mark: tuple, fresh: pd.DataFrame, ended: bool, time: str, side: str, window: float, margin: float) -> tuple[pd.DataFrame, pd.DataFrame, tuple]:
    """The asking rows that are ripe, ``margin`` older than the newest row, each with its partner's columns and ``dt``; rows that no later one can need are let go."""
    newest, _, count = mark
    fresh = fresh[fresh[time].notna()]
    parts = [f for f in (held, fresh) if len(f)]
    every = in_order(pd.concat(parts, ignore_index=True), time) if parts else held
    newest = max([newest, *fresh[time]]) if len(fresh) else newest
    until = float("inf") if ended else newest - margin
    asks = every[side].astype(bool) if len(every) else pd.Series([], dtype=bool)
    ripe, partners = every[asks & (every[time] < until)], every[~asks]
    at, other = ripe[time].to_numpy(float), partners[time].to_numpy(float)
    first = other[np.append(True, other[1:] != other[:-1])] if len(other) else other  # equal times: the first of them
    place = np.searchsorted(other, first)
    after = np.searchsorted(first, at)
    gap_before = np.where(after > 0, at - first[np.maximum(after - 1, 0)], np.inf) if len(first) else np.full(len(at), np.inf)
    gap_after = np.where(after < len(first), first[np.minimum(after, len(first) - 1)] - at, np.inf) if len(first) else np.full(len(at), np.inf)
    pick = np.where(gap_before <= gap_after, after - 1, after)
    met = np.minimum(gap_before, gap_after) <= window
    chosen = partners.iloc[place[pick[met]]] if met.any() else partners.iloc[:0]
    names = [c for c in every.columns if c != side]
    out = ripe[names].reset_index(drop=True)
    for c in names:
        column = pd.Series([None] * len(out), dtype=object)
        column[met] = chosen[c].to_list()
        out[f"near_{c}"] = column
    out["dt"] = np.where(met, np.where(gap_before <= gap_after, -gap_before, gap_after), np.nan) if len(out) else pd.Series([], dtype=float)
    out["dt"] = out["dt"].astype(object).where(met, None)
    keep = every[(asks & (every[time] >= until)) | (~asks & (every[time] >= until - window))] if len(every) else every
    return out, keep, (float(newest), float(until), count + len(out))


def nearest_in_stream(hits: DataFrame, asks: str, window_ns: float, disorder_ns: float, key: str = "run_number", time: str = "timestamp_ns", end: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """Each hit with true ``asks``, once, with the columns ``near_...`` of the hit with false ``asks`` that is nearest in time within ``window_ns``, and ``dt``; null without one.

    Of two equally near the earlier, of several at one time the first in the order of their columns. A hit waits until the newest is later by the window and
    ``disorder_ns``; a partner that comes later than that is not seen. State holds some window and disorder of time, not the run.
    """
    kept = T.StructType([f for f in hits.schema.fields if f.name not in (key, end)])
    plain = [f for f in kept.fields if f.name != asks]
    near = [T.StructField(f"near_{f.name}", f.dataType) for f in plain]
    out = T.StructType([hits.schema[key], *plain, *near, T.StructField("dt", T.DoubleType())])

    class Nearest(Held):
        def step(self, held, mark, fresh, ended):
            return nearest_step(held, mark, fresh, ended, time, asks, window_ns, window_ns + disorder_ns)

    return _run(hits, key, Nearest(kept, out.names, key, end, idle_ms), out, idle_ms)


def _run(hits: DataFrame, key: str, processor: StatefulProcessor, out: T.StructType, idle_ms: int | None) -> DataFrame:
    """The processor over the rows of each key."""
    exact = {f.name: f"cast(`{f.name}` as decimal(20, 0)) AS `{f.name}`" for f in hits.schema.fields if isinstance(f.dataType, T.LongType) and f.name != key}
    hits = hits.selectExpr(*[exact.get(c, f"`{c}`") for c in hits.columns])  # pandas would make longs beside nulls to doubles
    return hits.groupBy(key).transformWithStateInPandas(processor, out, "Append", "None" if idle_ms is None else "ProcessingTime")
