"""Raw digitizer read-outs to hits: aggregates of two 32-bit and two 64-bit firmware families, and a 64-bit one with user words and four trace lanes.

A read-out is a binary value. Only its records' places are walked, by the lengths they hold; fields and samples of all events are
then cut out of the words together. Each read-out stands for itself, so read-outs are decoded wherever Spark puts them; the one thing that goes on from
read-out to read-out, the wrapping board time behind interpolated times, is extended before by :func:`board_times`.

Families: ``charge32`` and ``height32`` (little-endian aggregates of dual-channel blocks of equal events), ``charge64`` and ``height64`` (big-endian
aggregates of events of one or more words), ``lanes64`` (big-endian events with up to four user words).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..operators.ordered import extended_counter
from . import blocks as B
from .chains import followed, spans

FAMILIES = ("charge32", "height32", "charge64", "height64", "lanes64")
#: Columns of a decoded hit; those of waveforms are the fields of :data:`blocks.WAVEFORM`.
COLUMNS = {"channel": pa.int32(), "energy": pa.int32(), "energy_short": pa.int32(), "timestamp_ns": pa.float64(), "fine_time": pa.int32(), "flags": pa.int64(),
           **{c: k for c, k in B.COLUMNS.items() if c not in ("source_id", "sequence_number", "batch_time", "module", *B.EVENT)}, "user_info": pa.list_(pa.int64())}
HIT = ("channel", "energy", "energy_short", "timestamp_ns", "fine_time", "flags")
#: Fixed values of the formats: record types, probe types without a name, and the probe types of the four lanes.
BOARD_TYPE, DATA_TYPE, SIGNAL_TYPE, START, STOP, NO_TYPE = 0xA, 0x2, 0x3, 0x0, 0x2, 255
LANE_TYPES, LANE_BITS = [0x40, 0x41, 0x42], [0x40, 0x41, 0x42, 0x43, 0x44]
LANE_STEP_NS, FINE_STEPS, PILE_UP = 8.0, 1024.0, 1 << 15


@dataclass
class Found:
    """Some events of a read-out: equally long arrays a field, ``(flat values, counts)`` for lists, and what was odd as ``(byte, fault)``."""

    rows: int = 0
    fields: dict = field(default_factory=dict)
    faults: list[tuple[int, str]] = field(default_factory=list)


def bits(words: np.ndarray, shift: int, width: int) -> np.ndarray:
    return (words >> words.dtype.type(shift) & words.dtype.type((1 << width) - 1)).astype(np.int64)


def signed(values: np.ndarray, width: int) -> np.ndarray:
    return values - (values >> (width - 1) << width)


def subcounter(wide: np.ndarray | int, raw: np.ndarray, width: int) -> np.ndarray:
    """A narrow counter's reading placed at or before a wide one; in the first period it may lie ahead."""
    placed = (wide >> width << width) + raw
    back = placed - (1 << width)
    return np.where((placed > wide) & (back >= 0), back, placed)


def board_headers(raw: bytes) -> Iterator[tuple[int, int, np.ndarray, str | None]]:
    """Byte, end and the four head words of each board aggregate of a read-out; the last may be a fault."""
    words, at = np.frombuffer(raw, "<u4", len(raw) // 4), 0
    while 4 * len(words) - at >= 16:
        head = words[at // 4 : at // 4 + 4]
        size = 4 * int(head[0] & 0x0FFFFFFF)
        if head[0] >> 28 != BOARD_TYPE:
            fault = "no board aggregate"
        else:
            fault = "aggregate past the end" if at + size > len(raw) else "aggregate without a head" if size < 16 else None
        yield at, at + size, head, fault
        if fault:
            return
        at += size


def events32(raw: bytes, height: bool, step_ns: float, board_time: list[int]) -> Found:
    """Hits of a 32-bit read-out; ``board_time`` has the extended time of each aggregate."""
    out, parts = Found(), []
    if len(raw) % 4 or len(raw) < 16:
        out.faults.append((0, "no whole words" if len(raw) % 4 else "too short"))
        return out
    words, counter = np.frombuffer(raw, "<u4"), None
    for number, (start, end, head, fault) in enumerate(board_headers(raw)):
        if fault:
            out.faults.append((start, fault))
            break
        if head[1] >> 26 & 1:
            out.faults.append((start, "board failed"))
        if counter is not None and int(head[2] & 0x7FFFFF) != (counter + 1) & 0x7FFFFF:
            out.faults.append((start, "aggregate missing"))
        counter, at = int(head[2] & 0x7FFFFF), start + 16
        for pair in range(8):
            if not head[1] >> pair & 1 or at >= end:
                continue
            if at + 8 > len(raw):
                out.faults.append((at, "channel block without a head"))
                break
            size, layout = int(words[at // 4] & (0x7FFFFFFF if height else 0x3FFFFF)), int(words[at // 4 + 1])
            stop, at = min(at + 4 * size, end), at + 8
            wave, extra, timed, physics = (layout >> b & 1 for b in (27, 28, 29, 30))
            samples = 4 * (layout & 0xFFFF) * wave
            long = timed + samples + extra + physics
            if long == 0:
                continue
            rows = max(0, stop - at) // (4 * long)
            if max(0, stop - at) % (4 * long):
                out.faults.append((at + 4 * long * rows, "event cut off"))
            body = words[at // 4 : at // 4 + rows * long].reshape(rows, long)
            if rows:
                time = board_time[number] if number < len(board_time) else 0
                parts.append(_block32(body, pair, height, step_ns, time, timed, samples, extra, physics, layout >> 24 & 7, layout >> 31))
            at = stop
    return merged(out, parts)


def _block32(body: np.ndarray, pair: int, height: bool, step_ns: float, board_time: int, timed: int, samples: int, extra: int, physics: int, option: int, dual: int) -> Found:
    rows, zero = len(body), np.zeros(len(body), np.uint32)
    tag = body[:, 0] if timed else zero
    word = body[:, timed + samples] if extra else zero
    last = body[:, -1] if physics else zero
    ticks, fine, flags = bits(tag, 0, 31), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    if extra and option == 5:  # two samples around the crossing of zero, or of the middle of the range
        before, after = bits(word, 16, 16), bits(word, 0, 16)
        before, after = (signed(before, 16), signed(after, 16)) if height else (before, after)
        down, rise = before - after, before if height else 8192 - after
        part = np.clip(np.divide(rise, down, out=np.zeros(rows), where=down != 0), 0, 1)
        fine = np.clip(part * FINE_STEPS, 0, 1023).astype(np.int64)
        time = subcounter(board_time, ticks, 31) * step_ns + part * step_ns
    else:
        fine = bits(word, 0, 10) if option == 2 else fine
        flags = bits(word, 10, 6) if option == 2 else bits(word, 0, 16) if option == 1 else flags
        time = ((bits(word, 16, 16) << 31) + ticks) * step_ns + fine * (step_ns / FINE_STEPS)
    flags = flags | bits(last, 15, 1) * PILE_UP
    high, low = bits(last, 16, 10 if height else 16), bits(last, 0, 15)
    found = {"channel": 2 * pair + bits(tag, 31, 1), "energy": low if height else high, "energy_short": high if height else low,
             "timestamp_ns": time, "fine_time": fine, "flags": flags, "has_waveform": np.full(rows, samples > 0 or False)}
    if samples:
        halves = np.stack([body[:, timed : timed + samples] & np.uint32(0xFFFF), body[:, timed : timed + samples] >> np.uint32(16)], axis=2)  # first, second sample of a word
        analog, many = signed(bits(halves, 0, 14), 14) if height else bits(halves, 0, 14), np.full(rows, 2 * samples)
        first, second = (bits(halves, b, 1).reshape(-1) for b in ((15, 14) if height else (14, 15)))
        held = np.repeat(analog, 2, axis=2)  # two traces share the words, each sample stands twice
        found |= {"analog_probe1": ((held[:, :, 2:] if dual else analog).reshape(-1), many), "digital_probe1": (first, many), "digital_probe2": (second, many)}
        found |= {"analog_probe2": (held[:, :, :2].reshape(-1), many)} if dual else {}
        found |= wave_facts(rows, step_ns, [height, height, False])
    return Found(rows, found)


def wave_facts(rows: int, step_ns: float, signs: list[bool], analog: list | None = None, digital: list | None = None) -> dict:
    """Fields of waveforms that are the same for all of them."""
    kinds = ((analog or []) + [NO_TYPE] * 3)[:3], ((digital or []) + [NO_TYPE] * 16)[:16]
    return {"ns_per_sample": np.full(rows, step_ns), **{s: np.full(rows, v) for s, v in zip(B.SIGNED, signs)},
            "analog_probe_type": (np.tile(kinds[0], rows), np.full(rows, 3)), "digital_probe_type": (np.tile(kinds[1], rows), np.full(rows, 16))}


def next_last(last: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of each place, one more than the first place from there on where ``last`` holds, or the end."""
    n = len(last)
    where = np.append(np.where(last, np.arange(n), n), [n] * 4)
    return np.minimum(np.minimum.accumulate(where[::-1])[::-1][np.minimum(start, n)] + 1, n)


def signal(words: np.ndarray) -> str | None:
    """Start and stop signals are read-outs of four and three words."""
    kind = (len(words), int(words[0] >> np.uint64(60)), int(words[0] >> np.uint64(56)) & 15) if len(words) else None
    return {(4, SIGNAL_TYPE, START): "start", (3, SIGNAL_TYPE, STOP): "stop"}.get(kind)


def cut(words: np.ndarray, size: np.ndarray, first: int, end: int) -> np.ndarray:
    """Places of the events from ``first`` to below ``end``, where an event at a place would have ``size`` words."""
    jump = np.append(np.minimum(np.arange(len(words)) + size, end), [end] * 2)
    jump[end:] = end
    return followed(jump, first, end) if end > first else np.empty(0, np.int64)


def at_or_zero(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.append(words, np.uint64(0))[np.minimum(places, len(words))]


def events64(raw: bytes, height: bool, step_ns: float, channels: int) -> Found:
    """Hits of a 64-bit aggregate; special events are counted as faults, one a read-out."""
    words, out = np.frombuffer(raw, ">u8", len(raw) // 8).astype(np.uint64), Found()
    kind = signal(words) if len(raw) % 8 == 0 else None
    if kind or len(raw) < 16 or words[0] >> np.uint64(60) != DATA_TYPE:
        out.faults.append((0, f"{kind} signal" if kind else "too short" if len(raw) < 16 else "no data aggregate"))
        return out
    size, n = int(words[0] & np.uint64(0xFFFFFFFF)), len(words)
    if words[0] >> np.uint64(56) & np.uint64(1):
        out.faults.append((0, "board failed"))
    if 8 * size != len(raw):
        out.faults.append((0, "size differs"))
    here, end = np.arange(n), min(size, n)
    last = bits(words, 63, 1) == 1
    second, head, length = at_or_zero(words, here + 1), at_or_zero(words, here + 2), at_or_zero(words, here + 3)
    special = bits(words, 55, 1) == 1
    asked = ~last & ~special & (bits(second, 62, 1) == 1) & (here + 4 <= n)
    waves = asked & (bits(head, 60, 4) == 8)
    samples = np.where(waves, bits(length, 0, 12), 0)
    whole = waves & (here + 4 + samples <= n)
    step = np.where(last, 1, np.where(special & (bits(second, 63, 1) == 0), next_last(last, here + 2) - here, 2 + np.where(waves, 2 + samples, 0)))
    places = cut(words, step, 1, n)  # an event that begins inside the aggregate is read to its end
    places = places[places < end]
    if len(places) and places[-1] + step[places[-1]] != size or not len(places) and size != 1:
        out.faults.append((8 * int(places[-1]) if len(places) else 8, "words do not fit the size"))
    alone = last[places]
    odd = ~alone & special[places]
    torn = ~alone & (places + 1 >= n)
    for mask, fault in ((odd & ~torn, "special events"), (torn, "event cut off"), (asked[places] & ~waves[places], "no waveform where one was due"), (waves[places] & ~whole[places], "waveform cut off")):
        if mask.any():
            out.faults.append((8 * int(places[mask][0]), f"{fault}: {int(mask.sum())}" if fault == "special events" else fault))
    places = places[alone | ~odd & ~torn]
    one, first, then = last[places], words[places], second[places]
    coarse, fine = np.where(one, bits(first, 16, 32), bits(first, 0, 48)), np.where(one, 0, bits(then, 16, 10))
    found = {
        "channel": bits(first, 56, 7), "energy": np.where(one, bits(first, 0, 16), bits(then, 0, 16)), "energy_short": np.where(one | height, 0, bits(then, 26, 16)),
        "timestamp_ns": coarse * step_ns + fine / FINE_STEPS * step_ns, "fine_time": fine,
        "flags": np.where(one, bits(first, 48, 8) << 12, (bits(then, 42, 8) << 12) + bits(then, 50, 12)), "has_waveform": whole[places],
    }
    if (found["channel"] >= channels).any():
        out.faults.append((8 * int(places[found["channel"] >= channels][0]), f"channels from {channels} on: {int((found['channel'] >= channels).sum())}"))
    many = np.where(whole[places], samples[places], 0)
    rows = len(places)
    if many.any() or whole[places].any():
        info = np.where(whole[places], head[places], np.uint64(0))
        signs = [bits(info, b, 1) == 1 if height else np.zeros(rows, bool) for b in (3, 9)]
        inner = words[spans(places + 4, many)]
        pairs = np.stack([inner & np.uint64(0xFFFFFFFF), inner >> np.uint64(32)], axis=1).reshape(-1)  # low half first
        owner = np.repeat(np.arange(rows), 2 * many)
        for name, shift, sign in (("analog_probe1", 0, signs[0]), ("analog_probe2", 16, signs[1])):
            plain = bits(pairs, shift, 14)
            found[name] = (np.where(sign[owner], signed(plain, 14), plain), 2 * many)
        found |= {f"digital_probe{k}": (bits(pairs, b, 1), 2 * many) for k, b in ((1, 14), (2, 15), (3, 30), (4, 31))}
        found |= wave_facts(rows, step_ns, [False] * 3) | {"time_resolution": bits(info, 44, 2), "trigger_threshold": bits(info, 28, 16)}
        if height:
            found |= {B.SIGNED[0]: signs[0], B.SIGNED[1]: signs[1]}
            analog = np.stack([bits(info, 0, 3), bits(info, 6, 3), np.full(rows, NO_TYPE)], axis=1)
            digital = np.full((rows, 16), NO_TYPE)
            digital[:, :4] = np.stack([bits(info, b, 4) for b in (12, 16, 20, 24)], axis=1)
            found |= {"analog_probe_type": (analog.reshape(-1), np.full(rows, 3)), "digital_probe_type": (digital.reshape(-1), np.full(rows, 16))}
    return merged(out, [Found(rows, found)])


def events_lanes(raw: bytes) -> Found:
    """Hits of a read-out with user words; traces of special events have four lanes: three signed traces and one of sixteen wires."""
    words, out = np.frombuffer(raw, ">u8", len(raw) // 8).astype(np.uint64), Found()
    n, kind = len(words), signal(words)
    if kind or len(raw) < 32:
        out.faults.append((0, f"{kind} signal" if kind else "too short"))
        return out
    here, last = np.arange(n), bits(words, 63, 1) == 1
    data = at_or_zero(words, here + 1)
    after = np.where(bits(data, 63, 1) == 1, np.minimum(here + 2, n), next_last(last, here + 2))
    traced = (bits(data, 62, 1) == 1) & (after < n)
    due = np.where(traced, bits(at_or_zero(words, after), 0, 12), 0)
    places = cut(words, np.where(traced, np.minimum(after + 1 + due, n), after) - here, 0, n)
    if len(places) and places[-1] == n - 1:  # a head without its data word
        out.faults.append((8 * (n - 1), "event cut off"))
        places = places[:-1]
    rows, then, after, traced = len(places), data[places], after[places], traced[places]
    users = after - places - 2
    many = np.minimum(due[places], np.maximum(n - after - 1, 0))
    if (many < due[places]).any():
        out.faults.append((8 * int(places[-1]), "waveform cut off"))
    if (users > 4).any():
        out.faults.append((8 * int(places[users > 4][0]), f"over four user words: {int((users > 4).sum())}"))
    slots = places[:, None] + 2 + np.arange(4)
    user = np.where(np.arange(4) < users[:, None], at_or_zero(words, slots) & np.uint64((1 << 63) - 1), np.uint64(0)).astype(np.int64)
    fine = bits(then, 16, 10)
    found = {
        "channel": bits(words[places], 56, 7), "energy": bits(then, 0, 16), "energy_short": bits(then, 26, 16), "fine_time": fine,
        "timestamp_ns": bits(words[places], 0, 48) * LANE_STEP_NS + fine / FINE_STEPS * LANE_STEP_NS, "flags": (bits(then, 42, 8) << 12) + bits(then, 50, 12),
        "has_waveform": traced, "user_info": (user.reshape(-1), np.full(rows, 4)),
    }
    if traced.any():
        special = bits(words[places], 55, 1) == 1
        inner, wide = words[spans(after + 1, many)], np.repeat(special, many)
        lanes = np.stack([bits(inner, 16 * k, 16) for k in range(4)], axis=1)
        kept = np.where(wide[:, None], [True, False, False, False], True)  # a plain trace takes all four as samples in a row
        found["analog_probe1"] = (signed(lanes, 16)[kept], np.where(special, many, 4 * many))
        for k in (1, 2):
            found[f"analog_probe{k + 1}"] = (signed(lanes[wide, k], 16), np.where(special, many, 0))
        for k in range(5):
            found[f"digital_probe{k + 1}"] = (lanes[wide, 3] >> (15 - k) & 1, np.where(special, many, 0))
        found |= wave_facts(rows, LANE_STEP_NS, [False] * 3) | {s: special for s in B.SIGNED}
        kinds = [np.where(special[:, None], (list(t) + [NO_TYPE] * w)[:w], NO_TYPE) for t, w in ((LANE_TYPES, 3), (LANE_BITS, 16))]
        found |= {c: (k.reshape(-1), np.full(rows, k.shape[1])) for c, k in zip(("analog_probe_type", "digital_probe_type"), kinds)}
    return merged(out, [Found(rows, found)], in_time=False)


def merged(out: Found, parts: list[Found], in_time: bool = True) -> Found:
    """The parts as one, by time; equal times stay in their order."""
    out.rows = sum(p.rows for p in parts)
    order = np.argsort(np.concatenate([p.fields["timestamp_ns"] for p in parts]), kind="stable") if in_time and out.rows else np.arange(out.rows)
    for name in dict.fromkeys(c for p in parts for c in p.fields):
        if pa.types.is_list(COLUMNS[name]):
            pieces = [p.fields.get(name, (np.empty(0, np.int64), np.zeros(p.rows, np.int64))) for p in parts]
            flat, count = np.concatenate([f for f, _ in pieces]), np.concatenate([c for _, c in pieces])
            out.fields[name] = (flat[spans((np.cumsum(count) - count)[order], count[order])], count[order])
        else:
            out.fields[name] = np.concatenate([p.fields.get(name, np.zeros(p.rows)) for p in parts])[order]
    return out


def events(raw: bytes, family: str, step_ns: float, channels: int, board_time: list[int]) -> Found:
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family}")
    if family == "lanes64":
        return events_lanes(raw)
    height = family.startswith("height")
    return events32(raw, height, step_ns, board_time) if family.endswith("32") else events64(raw, height, step_ns, channels)


def arrow_columns(found: Found, names: list[str]) -> list[pa.Array]:
    """Arrow arrays of the named columns; a field of a waveform is null where there is none."""
    made, wave = [], found.fields.get("has_waveform", np.zeros(found.rows, bool)).astype(bool)
    for name in names:
        kind, none = COLUMNS[name], ~wave if name in B.WAVEFORM else np.zeros(found.rows, bool)
        if pa.types.is_list(kind):
            rows = 4 if name == "user_info" else 0
            flat, count = found.fields.get(name, (np.zeros(rows * found.rows, np.int64), np.full(found.rows, rows)))
            flat, count = flat[np.repeat(~none, count)], np.where(none, 0, count)
            offsets = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32), mask=np.append(none, False) if none.any() else None)
            made.append(pa.ListArray.from_arrays(offsets, pa.array(flat).cast(kind.value_type)).cast(kind))
        else:
            values = found.fields.get(name, np.zeros(found.rows))
            made.append(pa.array(values.astype(kind.to_pandas_dtype()), kind, mask=none))
    return made


def kept_fields(rows: DataFrame, names: list[str]) -> list[T.StructField]:
    """The first columns' fields under their own names."""
    return [T.StructField(n, f.dataType) for n, f in zip(names, rows.schema.fields)]


def decode(raw: DataFrame, family: str, keep: list[str], content: str = "content", step_ns: float = 2.0, channels: int = 32, columns: list[str] | None = None, board_time: str | None = None) -> DataFrame:
    """One row a hit of every read-out: the ``keep`` columns, ``place`` in the read-out by time, then ``columns`` of :data:`COLUMNS`.

    ``board_time`` names the array that :func:`board_times` makes; interpolated times of a 32-bit family need it. Broken records end as told by :func:`faults`.
    """
    names = list(columns or (HIT + (("user_info",) if family == "lanes64" else ())))
    rows = raw.select(*[F.col(f"`{k}`").alias(f"_{i}") for i, k in enumerate(keep)], F.col(content).alias("_raw"), (F.col(board_time) if board_time else F.array().cast("array<bigint>")).alias("_time"))
    made = from_arrow_schema(pa.schema([("place", pa.int32())] + [(c, COLUMNS[c]) for c in names]))
    schema = T.StructType([*kept_fields(rows, keep), *made.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, times = batch.column(len(keep))[i].as_py(), batch.column(len(keep) + 1)[i].as_py()
                found = events(data or b"", family, step_ns, channels, times or [])
                if found.rows:
                    own = [pa.repeat(batch.column(k)[i], found.rows) for k in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(found.rows, dtype=np.int32)), *arrow_columns(found, names)], schema=arrow)

    return rows.mapInArrow(run, schema)


def faults(raw: DataFrame, family: str, keep: list[str], content: str = "content", channels: int = 32) -> DataFrame:
    """What is broken or no hit in the read-outs: ``keep`` columns, the ``byte`` it was met at, and the ``fault``."""
    rows = raw.select(*[F.col(f"`{k}`").alias(f"_{i}") for i, k in enumerate(keep)], F.col(content).alias("_raw"))
    schema = T.StructType([*kept_fields(rows, keep), T.StructField("byte", T.LongType()), T.StructField("fault", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                odd = events(batch.column(len(keep))[i].as_py() or b"", family, 1.0, channels, []).faults
                if odd:
                    own = [pa.repeat(batch.column(k)[i], len(odd)) for k in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([a for a, _ in odd], pa.int64()), pa.array([f for _, f in odd])], schema=arrow)

    return rows.mapInArrow(run, schema)


def board_times(raw: DataFrame, source: str, sequence: str, content: str = "content") -> DataFrame:
    """``raw`` with ``board_time``: the 32-bit board times of its aggregates, extended over all read-outs of a source in their sequence.

    A time that comes late in the first period has the one before it.
    """
    rows = raw.select(F.col(source).alias("_source"), F.col(sequence).alias("_sequence"), F.col(content).alias("_raw"))
    kinds = T.StructType([rows.schema["_source"], rows.schema["_sequence"]]).add("number", "integer").add("tag", "long")
    arrow = to_arrow_schema(kinds)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tags = [int(head[3]) for _, _, head, fault in board_headers(batch.column(2)[i].as_py() or b"") if not fault]
                own = [pa.repeat(batch.column(k)[i], len(tags)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(range(len(tags)), pa.int32()), pa.array(tags, pa.int64())], schema=arrow)

    order = F.struct("_sequence", "number").alias("at")
    wide = extended_counter(rows.mapInArrow(heads, kinds).withColumn("at", order), "at", "tag", 32, ["_source"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("number", "held"))), lambda x: x["held"])
    times = wide.withColumn("held", F.coalesce("extended", "held")).groupBy("_source", "_sequence").agg(listed.alias("board_time"))
    met = raw.join(times, F.col(source).eqNullSafe(F.col("_source")) & F.col(sequence).eqNullSafe(F.col("_sequence")), "left")
    return met.drop("_source", "_sequence")
