"""Decoding of digitizer words: two 32-bit families with dual-channel boards, and a 64-bit family with single-channel aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def words(content: Column, size: int, big_endian: bool) -> Column:
    """A binary column as an array of unsigned words of ``size`` bytes."""
    count = F.floor(F.octet_length(content) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.hex(F.substring(content, i * size + 1, F.lit(size))))
    swapped = cut if big_endian else F.transform(cut, lambda h: F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(size))]))
    return F.when(count > 0, F.transform(swapped, lambda h: F.conv(h, 16, 10).cast("decimal(20,0)").cast("long") if size < 8 else F.conv(h, 16, -10).cast("long"))).otherwise(F.array().cast("array<long>"))


def compressed_events(rows: DataFrame, word: str, step_ns: float) -> DataFrame:
    """Hits of single-word events of the 64-bit family: channel, special bit, coarse time, energy.

    Special events are dropped by ``special = 0`` by the caller, so that they can be counted.
    """
    w = F.col(word)
    return rows.select(
        *[c for c in rows.columns if c != word], C.bits(w, 56, 7).cast("int").alias("channel"), C.bits(w, 55, 1).cast("int").alias("special"),
        C.bits(w, 16, 32).alias("coarse"), C.bits(w, 0, 16).cast("int").alias("energy"), (C.bits(w, 16, 32) * F.lit(step_ns)).alias("timestamp_ns"),
    )


def physics_events(rows: DataFrame, time_word: str, extra_word: str, charge_word: str, pair: Column, step_ns: float) -> DataFrame:
    """Hits of the 32-bit family: time word (channel bit and 31-bit counter), extras word (extension, flags, fine time), charge word."""
    t, x, q = F.col(time_word), F.col(extra_word), F.col(charge_word)
    parts = C.psd_physics(q)
    time = C.hardware_time(C.bits(x, 16, 16), C.bits(t, 0, 31), C.bits(x, 0, 10), step_ns)
    rest = [c for c in rows.columns if c not in (time_word, extra_word, charge_word)]
    flags = C.remap_flags(C.bits(x, 10, 6)).bitwiseOR(F.when(parts["pileup"] == 1, F.lit(C.FLAGS["pileup"])).otherwise(F.lit(0)).cast("long"))
    return rows.select(*rest, (pair * 2 + C.bits(t, 31, 1)).cast("int").alias("channel"), time.alias("timestamp_ns"),
                       parts["energy"].cast("int").alias("energy"), parts["energy_short"].cast("int").alias("energy_short"), flags.alias("flags"))
