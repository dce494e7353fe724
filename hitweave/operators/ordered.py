"""Ordered operators that never put all rows into one task.

Rows are dealt to ranges of the ordering value. Inside a range an ordinary
window works; what crosses a range border comes from a summary with one row a
range, at most some ``MAX_RANGES`` of them, so the results are those of one global window.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import dealt_in_order, durable

MAX_RANGES = 1 << 17
MAX_ROUNDS = 64  # a bound: every round cuts each full range at least once; 200,000 powers of two take some eight


def with_range(rows: DataFrame, value: str, rows_per_range: int = 1 << 16) -> DataFrame:
    """Adds ``_range``, which rises with ``value``; about ``rows_per_range`` rows each, more where ``MAX_RANGES`` of them don't hold all.

    Ranges are of equal width first. Ranges that are too full (an outlier stretched the scale, or hits came in a burst) are cut again,
    between their own least and greatest value, until none is. What a round needs is one row a range, written once, so that rounds add
    up and don't multiply. Equal values stay together.
    """
    low, high, count = rows.agg(F.min(value), F.max(value), F.count("*")).first()
    size = max(rows_per_range, -(-count // MAX_RANGES))
    ranges = max(1, count // size)
    if low is None or high == low or ranges == 1:
        return rows.withColumn("_range", F.lit(0).cast("long"))
    dealt = rows.withColumn("_range", F.floor((F.col(value) - F.lit(low)) / F.lit((high - low) / ranges)).cast("long"))
    for _ in range(MAX_ROUNDS):
        heads = durable(dealt.groupBy("_range").agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count("*").alias("_n")))
        if heads.filter((F.col("_n") > 4 * size) & (F.col("_low") < F.col("_high"))).isEmpty():
            break
        heads = heads.withColumn("_pieces", F.when((F.col("_n") > size) & (F.col("_low") < F.col("_high")), F.ceil(F.col("_n") / size)).otherwise(1)).drop("_n")
        before = F.coalesce(F.sum("_pieces").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        met = dealt.join(F.broadcast(heads.withColumn("_before", before)), "_range", "left")  # a few times MAX_RANGES rows at most
        piece = F.floor((F.col(value) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0)) * F.col("_pieces"))
        cut = F.col("_before") + F.least(F.coalesce(piece, F.lit(0)), F.col("_pieces") - 1)
        dealt = met.withColumn("_range", cut.cast("long")).drop("_low", "_high", "_pieces", "_before")
    return dealt


def lag_global(rows: DataFrame, value: str, order: list[str], names: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """Adds for every ``{new: old}`` of ``names`` the old column of the row before in ``order``, which begins with ``value``.

    With ``keys``, the row before among those of equal keys; a key of any size is spread over its ranges.
    """
    keys = keys or []
    dealt = rows if "_range" in rows.columns else with_range(rows, value)
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    placed = dealt.withColumns({f"_lag_{k}": F.lag(v).over(inside) for k, v in names.items()} | {"_first": F.row_number().over(inside) == 1})
    lasts = dealt.groupBy(*keys, "_range").agg(F.max_by(F.struct(*dict.fromkeys(names.values())), F.struct(*order)).alias("_last"))
    carry = lasts.select(*keys, "_range", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range")).alias("_carry"))
    joined = placed.join(carry if keys else F.broadcast(carry), [*keys, "_range"], "left")
    for new, old in names.items():
        joined = joined.withColumn(new, F.when(F.col("_first"), F.col(f"_carry.{old}")).otherwise(F.col(f"_lag_{new}")))
    return joined.drop("_first", "_carry", *[f"_lag_{k}" for k in names])


def running_sum(rows: DataFrame, value: str, order: list[str], amount: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over all rows (of equal ``keys``) up to this one in ``order``, which begins with ``value``."""
    keys = keys or []
    dealt = rows if "_range" in rows.columns else with_range(rows, value)
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.groupBy(*keys, "_range").agg(F.sum(amount).alias("_part"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(*keys, "_range", F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_shift"))
    placed = dealt.withColumn("_here", F.sum(amount).over(inside)).join(shift if keys else F.broadcast(shift), [*keys, "_range"])
    return placed.withColumn(name, F.col("_here") + F.col("_shift")).drop("_here", "_shift")


def running_max(rows: DataFrame, value: str, order: list[str], amount: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Adds ``name``: the greatest ``amount`` of all rows (of equal ``keys``) up to this one in ``order``, which begins with ``value``."""
    keys = keys or []
    dealt = rows if "_range" in rows.columns else with_range(rows, value)
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    tops = dealt.groupBy(*keys, "_range").agg(F.max(amount).alias("_part"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(*keys, "_range", F.max("_part").over(before).alias("_carry"))
    placed = dealt.withColumn("_here", F.max(amount).over(inside)).join(carry if keys else F.broadcast(carry), [*keys, "_range"])
    return placed.withColumn(name, F.greatest("_here", "_carry")).drop("_here", "_carry")


def extended_counter(rows: DataFrame, order: str, raw: str, bits: int, keys: list[str]) -> DataFrame:
    """Adds ``extended`` and ``late``, and ``held``, the extended last reading on time up to here, of a counter of ``bits`` bits that wraps, in the order of ``order``, then ``raw``, among equal ``keys``.

    Each reading is compared with the last one that was on time. A step forward of at most half a period is on time, and begins the next epoch
    where the counter falls. Any other reading is late: it belongs to the epoch before and changes nothing; in the first epoch it has no place and
    ``extended`` is null. Bits above ``bits`` are cut off; null readings stay null and change nothing.

    Rows are sorted over all tasks and written once. A first pass tells for each task what its first key does to any last reading
    that the task before may end with; the driver chains these few numbers a task, and a second pass counts with the right beginning.
    """
    columns = [c for c in rows.columns if c not in ("extended", "late", "held")]
    dealt = dealt_in_order(rows.select(*columns), [F.col(c) for c in (*keys, order, raw)])
    places = [columns.index(k) for k in keys]
    at, mask = columns.index(raw), (1 << bits) - 1

    def readings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, tuple]], np.ndarray, np.ndarray]]:
        """Each batch with its runs ``(first, end, key)``, its readings, 0 for null, and which are not null."""
        for batch in batches:
            if batch.num_rows:
                names = list(zip(*(batch.column(i).to_pylist() for i in places))) or [()] * batch.num_rows
                edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
                column = batch.column(at).cast(pa.int64())
                yield batch, [(a, b, names[a]) for a, b in zip(edges[:-1], edges[1:])], column.fill_null(0).to_numpy() & mask, column.is_valid().to_numpy(zero_copy_only=False)

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a task: its first key with its effect, and its last key with how it ends if it began here."""
        first, last, effect, end = None, None, None, None
        for _, runs, values, valid in readings(batches):
            for a, b, key in runs:
                some = values[a:b][valid[a:b]]
                if first is None:
                    first, effect = (key,), CounterEffect(bits)
                if last != (key,):
                    last, end = (key,), (None, 0)
                if first == (key,):
                    effect.read(some)
                _, _, end = counted(some, bits, end)
        if first is not None:
            found = pickle.dumps((first, effect.arcs(), last, end))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([found], pa.binary())], ["task", "found"])

    begin: dict[int, tuple] = {}  # of each task whose first key goes on from the task before: the key and its state; a few numbers a task
    before: tuple = (None, (None, 0))
    for task, found in sorted(tuple(r) for r in dealt.mapInArrow(effects, "task long, found binary").collect()):
        first, arcs, last, end = pickle.loads(found)
        if before[0] == first:
            begin[task] = (first, before[1])
            if last == first:
                end = after_arcs(arcs, before[1], end)
        before = (last, end)

    schema = T.StructType([*dealt.schema.fields, T.StructField("extended", T.LongType()), T.StructField("late", T.BooleanType()), T.StructField("held", T.LongType())])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = begin.get(TaskContext.get().partitionId(), (None, (None, 0)))
        for batch, runs, values, valid in readings(batches):
            wide, late, held = np.zeros(len(values), np.int64), np.zeros(len(values), bool), np.full(len(values), -1)
            known = valid.copy()
            for a, b, name in runs:
                if key != (name,):
                    key, state = (name,), (None, 0)
                here = a + np.flatnonzero(valid[a:b])
                before = -1 if state[0] is None else (state[1] << bits) + state[0]
                epochs, behind, state = counted(values[here], bits, state)
                wide[here], late[here], known[here] = (epochs << bits) + values[here], behind, epochs >= 0
                held[here] = np.maximum.accumulate(np.concatenate(([before], np.where(behind, -1, wide[here]))))[1:]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(wide, mask=~known), pa.array(late), pa.array(held, mask=~valid)], schema.names)

    return dealt.mapInArrow(extend, schema)


def counted(values: np.ndarray, bits: int, state: tuple) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Epoch of each reading (-1: none), whether it is late, and the state after: the last reading on time and the epoch."""
    last, epoch = state
    mask, half = (1 << bits) - 1, 1 << (bits - 1)
    if len(values) == 0:
        return np.empty(0, np.int64), np.empty(0, bool), state
    joined = np.concatenate(([values[0] if last is None else last], values))
    if not ((joined[1:] - joined[:-1] & mask) > half).any():
        epochs = epoch + np.cumsum(joined[1:] < joined[:-1])
        return epochs, np.zeros(len(values), bool), (int(values[-1]), int(epochs[-1]))
    epochs, late = np.empty(len(values), np.int64), np.zeros(len(values), bool)
    last = int(joined[0])
    for i, value in enumerate(values.tolist()):
        if value - last & mask > half:
            epochs[i], late[i] = epoch - 1, True
        else:
            epoch += value < last
            epochs[i], last = epoch, value
    return epochs, late, (last, epoch)


class CounterEffect:
    """What readings do to any last reading on time before them, as arcs of such values that fare alike.

    An arc either has met no reading that is on time for it and keeps its own value, or follows a track: a last reading, epochs begun since.
    Tracks that come to the same reading go on as one, after which the rest is plain counting.
    """

    def __init__(self, bits: int) -> None:
        self.bits, self.open = bits, [(0, (1 << bits) - 1)]
        self.tracks: list[list[int]] = []  # last reading, epochs begun
        self.held: list[tuple[int, int, int, int]] = []  # first and last value of the arc, its track, epochs more than the track's

    def read(self, values: np.ndarray) -> None:
        at = 0
        while at < len(values) and (self.open or len(self.tracks) > 1):
            self._one(int(values[at]))
            at += 1
        if at < len(values):
            _, _, state = counted(values[at:], self.bits, tuple(self.tracks[0]))
            self.tracks[0] = list(state)

    def _one(self, value: int) -> None:
        period, half = 1 << self.bits, 1 << (self.bits - 1)
        for track in self.tracks:
            if value - track[0] & (period - 1) <= half:
                track[1] += value < track[0]
                track[0] = value
        fresh = []
        for low, high, more in ((max(0, value - half), value, 0), (value - half + period, period - 1, 1)):  # before it, and from the epoch before
            for a, b in self.open:
                if max(a, low) <= min(b, high):
                    fresh.append((max(a, low), min(b, high), more))
        if fresh:
            self.tracks.append([value, 0])
            self.held += [(a, b, len(self.tracks) - 1, more) for a, b, more in fresh]
            for a, b, _ in fresh:
                self.open = [piece for x, y in self.open for piece in ((x, min(y, a - 1)), (max(x, b + 1), y)) if piece[0] <= piece[1]]
        self._join()

    def _join(self) -> None:
        first: dict[int, int] = {}
        kept, moved = [], {}
        for i, (last, begun) in enumerate(self.tracks):
            if last not in first:
                first[last] = len(kept)
                kept.append([last, begun])
            moved[i] = (first[last], begun - kept[first[last]][1])
        self.tracks = kept
        self.held = [(a, b, moved[t][0], more + moved[t][1]) for a, b, t, more in self.held]

    def arcs(self) -> list[tuple[int, int, int | None, int]]:
        """``first, last, reading after (none: its own), epochs begun`` of every arc."""
        return [(a, b, None, 0) for a, b in self.open] + [(a, b, self.tracks[t][0], self.tracks[t][1] + more) for a, b, t, more in self.held]


def after_arcs(arcs: list[tuple], state: tuple, fresh: tuple) -> tuple:
    """The state after readings with these arcs, from ``state``; ``fresh`` is the state if nothing came before."""
    if state[0] is None:
        return fresh
    last, begun = next((q, n) for a, b, q, n in arcs if a <= state[0] <= b)
    return (state[0] if last is None else last, state[1] + begun)


def dense_number(rows: DataFrame, value: str, order: list, name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... in ``order``, which begins with ``value``."""
    counted = running_sum(rows.withColumn("_one", F.lit(1).cast("long")), value, order, "_one", name)
    return counted.withColumn(name, F.col(name) - 1).drop("_one", "_range")


def bucket(value: Column | str, width: float) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value / F.lit(float(width))).cast("long")


def range_join(windows: DataFrame, points: DataFrame, start: str, end: str, point: str, width: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs of a window and a point inside it, both ends included, by an equi-join on time buckets.

    A window is copied to every bucket it touches, a point to its own; take
    ``width`` at least as wide as most windows. ``keys`` are equal on both sides.
    """
    spread = windows.withColumn("_bucket", F.explode(F.sequence(bucket(start, width), bucket(end, width))))
    dealt = points.withColumn("_bucket", bucket(point, width))
    inside = (F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end))
    return spread.join(dealt, ["_bucket", *(keys or [])]).filter(inside).drop("_bucket")


def nearest(left: DataFrame, right: DataFrame, at: str, other: str, window: float, right_order: list[str]) -> DataFrame:
    """Each left row with ``_near``, the struct of the right row nearest in time within ``window``, or null.

    Of two equally near, the earlier; of right rows of one time, the first by
    ``right_order``. Right rows are copied to the neighbouring buckets of width ``window``, then
    one pass per bucket finds the last before and the first after.
    """
    names = right.columns
    pack = F.struct(*names)
    firsts = right.groupBy(other).agg(F.min_by(pack, F.struct(*right_order)).alias("_r")) if right_order else right.select(other, pack.alias("_r"))
    own = bucket(other, window)
    spread = firsts.select(F.col(other).alias("_t"), "_r", F.explode(F.sequence(own - 1, own + 1)).alias("_b"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"))
    asked = left.select(F.col(at).alias("_t"), F.lit(None).cast(spread.schema["_r"].dataType).alias("_r"), bucket(at, window).alias("_b"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    both = spread.unionByName(asked)
    back = Window.partitionBy("_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("_b").orderBy(F.desc("_t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_before", F.last("_r", ignorenulls=True).over(back)).withColumn("_after", F.last("_r", ignorenulls=True).over(ahead))
    found = found.filter("_side = 1")
    gap = {c: F.abs(F.col(f"{c}.{other}") - F.col("_t")) for c in ("_before", "_after")}
    ok = {c: g <= F.lit(float(window)) for c, g in gap.items()}
    pick = (
        F.when(ok["_before"] & (~F.coalesce(ok["_after"], F.lit(False)) | (gap["_before"] <= gap["_after"])), F.col("_before"))
        .when(ok["_after"], F.col("_after"))
    )
    return found.select("_l.*", pick.alias("_near"))
