"""Waveform functions. What array functions express stays in the JVM; recursions and crossings run in numpy, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0).cast("long"), lambda acc, x: acc + x)


def baseline(samples: Column, n: int) -> Column:
    """Mean of the first ``min(n, size / 2)`` samples; null without any."""
    used = F.least(F.lit(n), F.floor(F.size(samples) / 2).cast("int"))
    return F.when(used > 0, total(F.slice(samples, 1, F.greatest(used, F.lit(1)))) / used)


def extremum(samples: Column, negative: bool, skip: int = 0) -> Column:
    """Struct ``value, index`` past the first ``min(skip, size / 2)`` samples: the first least one of a negative pulse, the last greatest of a positive one."""
    indexed = F.transform(samples, lambda x, i: F.struct(x.alias("value"), i.alias("index")))
    past = F.filter(indexed, lambda s: s["index"] >= F.least(F.lit(skip), F.floor(F.size(samples) / 2)))
    return F.array_min(past) if negative else F.array_max(past)


def gated_charge(samples: Column, start: Column, length: int, ground: Column, sign: int = 1) -> Column:
    """Sum of sign-corrected samples above ``ground`` in a gate cut to the waveform."""
    first = F.greatest(start, F.lit(0))
    n = F.greatest(F.least(start + length, F.size(samples)) - first, F.lit(0))
    part = F.slice(samples, first + 1, n)
    return (total(part) - ground * F.size(part)) * sign


def exploded(rows, samples: str = "samples", ns: str = "ns_per_sample"):
    """One row a sample with ``sample_idx``, ``time_ns`` and ``adc``."""
    others = [c for c in rows.columns if c not in (samples, ns)]
    spread = rows.select(*others, ns, F.posexplode(samples).alias("sample_idx", "adc"))
    return spread.select(*others, "sample_idx", (F.col("sample_idx") * F.col(ns)).alias("time_ns"), "adc")


def deinterleave(samples: Column, odd: bool) -> Column:
    """One trace of two that alternate, each sample held for two."""
    return F.transform(samples, lambda x, i: F.element_at(samples, (F.floor(i / 2) * 2 + (2 if odd else 1)).cast("int")))


def lane(words: Column, number: int, bits: int = 16) -> Column:
    """Lane ``number`` of words that carry several."""
    return F.transform(words, lambda w: F.shiftright(w, number * bits).bitwiseAND(F.lit((1 << bits) - 1)))


def rising_edge(probe: Column) -> Column:
    """Index of the first asserted sample; null without one."""
    return F.nullif(F.array_position(F.transform(probe, lambda x: (x != 0).cast("int")), 1), F.lit(0)) - 1


def asserted_centre(probe: Column) -> Column:
    """Whole mean index of the asserted samples; null without one."""
    at = F.filter(F.transform(probe, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
    return F.when(F.size(at) > 0, F.floor(total(at) / F.size(at)).cast("long"))


def per_waveform(function: Callable[[np.ndarray], object], kind: str) -> Callable[[Column], Column]:
    """A column function that maps numpy samples to a value of Spark type ``kind``; null for null or empty samples."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([None if r is None or not len(r) else function(np.asarray(r, np.float64)) for r in rows], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def moving_average(taps: int) -> Callable[[Column], Column]:
    """Mean of the last ``taps`` samples, of as many as there are at the start."""

    def run(x: np.ndarray) -> list[float]:
        sums = np.cumsum(x)
        sums[taps:] -= sums[:-taps].copy() if taps < len(x) else 0
        return (sums / np.minimum(np.arange(1, len(x) + 1), taps)).tolist()

    return per_waveform(run, "array<double>")


def trapezoid(rise: int, flat: int, pole_zero: float) -> Callable[[Column], Column]:
    """Trapezoidal filter with pole-zero correction; before the first sample the input stood at its value."""

    def run(x: np.ndarray) -> list[float]:
        past = rise + rise + flat
        v = np.concatenate([np.full(past, x[0]), x])
        n = len(x)
        d = v[past:] - v[past - rise : past - rise + n] - v[past - rise - flat : past - rise - flat + n] + v[:n]
        p = np.cumsum(d)
        return np.cumsum(p + pole_zero * d).tolist()

    return per_waveform(run, "array<double>")


def crossing(fraction: float, delay: int, negative: bool, n_baseline: int = 8) -> Callable[[Column], Column]:
    """Constant-fraction time in samples and whether a crossing was found; the peak's sample otherwise."""

    def run(x: np.ndarray) -> dict:
        if len(x) < n_baseline + delay + 4:
            return {"time": None, "valid": False}
        skip = min(n_baseline, len(x) // 2)
        y = (x - x[:skip].mean()) * (-1 if negative else 1)
        peak = skip + int(np.argmax(y[skip:])) if negative else len(y) - 1 - int(np.argmax(y[skip:][::-1]))
        s = fraction * y[delay:] - y[:-delay]
        least = max(peak - max(16, 4 * delay), skip, delay + 1)
        for i in range(peak - 1, least, -1):
            now, later = s[i - delay], s[i + 1 - delay]
            if now > 0 >= later:
                return {"time": i + now / (now - later), "valid": True}
        return {"time": float(peak), "valid": False}

    def batches_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [{"time": None, "valid": False} if r is None or not len(r) else run(np.asarray(r, np.float64)) for r in rows]
            yield pd.DataFrame(found, columns=["time", "valid"])

    batches_of.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(batches_of, "time double, valid boolean")


def trapezoid_energy(trigger: int, rise: int, flat: int, guard: int = 8, window: int = 16, part: float = 0.8, mean_of: int = 8) -> Callable[[Column], Column]:
    """Mean of the flat top less the baseline before the trigger, from a filtered trace."""

    def run(x: np.ndarray) -> float:
        end = max(0, trigger - guard)
        before = x[max(0, end - window) : end]
        low = max(0, trigger + int(rise + part * flat + 0.5) - mean_of // 2)
        return float(x[low : low + mean_of].mean() - (before.mean() if len(before) else 0.0))

    return per_waveform(run, "double")
