"""Column functions on hits, digitizer words and settings; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flag bits of a hit, and the raw digitizer bits they come from.
FLAGS = {"pileup": 0x01, "trigger_lost": 0x02, "over_range": 0x04, "trigger_1024": 0x08, "n_lost": 0x10}
RAW_BITS = {"pileup": 15, "trigger_lost": 5, "over_range": 4, "trigger_1024": 3, "n_lost": 2}


def has_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(F.lit(FLAGS[name])) != 0


def remap_flags(raw: Column) -> Column:
    """Common flag bits of a raw flag word."""
    out = F.lit(0).cast("long")
    for name, bit in RAW_BITS.items():
        out = out.bitwiseOR(F.when(F.shiftright(raw, bit).bitwiseAND(F.lit(1)) == 1, F.lit(FLAGS[name])).otherwise(F.lit(0)).cast("long"))
    return out


def psd_ratio(energy: Column, short: Column) -> Column:
    """``(energy - short) / energy``, null without energy."""
    return F.when(energy > 0, (energy - short) / energy)


def polynomial(x: Column, *terms: Column) -> Column:
    """``p0 + p1 x + p2 x^2 + ...`` by Horner's rule."""
    out = terms[-1]
    for p in reversed(terms[:-1]):
        out = out * x + p
    return out


def hardware_time(extended: Column, coarse: Column, fine: Column, step_ns: float) -> Column:
    """Time of a 31-bit coarse counter with its extension and a fine part of 1/1024."""
    return (F.shiftleft(extended.cast("long"), 31).bitwiseOR(coarse.cast("long"))) * F.lit(step_ns) + fine * F.lit(step_ns) / 1024


def software_time(counter: Column, fraction: Column, step_ns: float) -> Column:
    return counter * F.lit(step_ns) + fraction * F.lit(step_ns)


def psd_fraction(before: Column, after: Column, baseline: int = 8192) -> Column:
    """Zero-crossing fraction of unsigned samples around ``baseline``; 0 without a slope."""
    raw = (F.lit(baseline) - after) / F.nullif(before - after, F.lit(0))
    return F.coalesce(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def pha_fraction(before: Column, after: Column) -> Column:
    """Zero-crossing fraction of signed samples; 0 without a slope."""
    raw = before / F.nullif(before - after, F.lit(0))
    return F.coalesce(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def bits(word: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(word, low).bitwiseAND(F.lit((1 << width) - 1))


def psd_physics(word: Column) -> dict[str, Column]:
    """Long charge, pile-up and short charge of a 32-bit word."""
    return {"energy": bits(word, 16, 16), "pileup": bits(word, 15, 1), "energy_short": bits(word, 0, 15)}


def pha_physics(word: Column) -> dict[str, Column]:
    """Energy, pile-up and extra bits of a 32-bit word."""
    return {"energy": bits(word, 0, 15), "pileup": bits(word, 15, 1), "extra": bits(word, 16, 10)}


def sign_extend(value: Column, width: int = 14) -> Column:
    """The two's complement value of the low ``width`` bits."""
    return F.shiftright(F.shiftleft(value.cast("int"), 32 - width), 32 - width)


def in_units(rate: Column, units: list[tuple[float, str]], rest: str) -> Column:
    """Two decimals and the unit of the first scale reached; below all of them no decimals (halves to even) and ``rest``."""
    out = F.format_string(f"%.0f {rest}", F.rint(rate))
    for scale, name in reversed(units):
        out = F.when(rate >= scale, F.format_string(f"%.2f {name}", rate / scale)).otherwise(out)
    return out


def rate_text(rate: Column) -> Column:
    """A rate of events with unit M, K or none."""
    return in_units(rate, [(1e6, "M/s"), (1e3, "K/s")], "/s")


def byte_rate_text(rate: Column) -> Column:
    return in_units(rate, [(1e9, "GB/s"), (1e6, "MB/s"), (1e3, "KB/s")], "B/s")


def loss_percent(lost: Column, triggers: Column) -> Column:
    return F.when(triggers > 0, lost * 100.0 / triggers).otherwise(F.lit(0.0))


def snapped(value: Column, low: float, high: float, step: float) -> Column:
    """The nearest ``low + k * step`` inside ``[low, high]``."""
    return F.least(F.greatest(F.lit(low) + F.floor((value - F.lit(low)) / F.lit(step) + 0.5) * F.lit(step), F.lit(low)), F.lit(high))


def snap_status(value: Column, low: float, high: float, step: float) -> Column:
    return F.when(value.isNull(), "invalid").when(snapped(value, low, high, step) == value, "ok").otherwise("adjusted")


def mask_bits(mask: Column, n: int) -> Column:
    """A boolean for each of the ``n`` lowest bits of a hex string mask."""
    number = F.conv(F.regexp_replace(F.lower(mask), "^0x", ""), 16, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.call_function("shiftrightunsigned", number, i).bitwiseAND(F.lit(1)) == 1)


def bits_mask(enabled: Column) -> Column:
    """The hex string mask of an array of booleans."""
    total = F.aggregate(
        F.transform(enabled, lambda on, i: F.when(on, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda acc, v: acc.bitwiseOR(v),
    )
    return F.concat(F.lit("0x"), F.lower(F.hex(total)))


def overlay(base: dict[str, Column], over: dict[str, Column]) -> dict[str, Column]:
    """Per-field override: the overriding value where there is one."""
    return {k: F.coalesce(over[k], v) if k in over else v for k, v in base.items()}


def gain_update(voltage: Column, target: Column, peak: Column, alpha: float, max_step: float) -> Column:
    """``V (target / peak)^(1 / alpha)``, moved by at most ``max_step`` and never below 0; unchanged without a peak."""
    wanted = voltage * F.pow(target / peak, F.lit(1.0 / alpha))
    step = F.least(F.greatest(wanted - voltage, F.lit(-max_step)), F.lit(max_step))
    return F.when(peak > 0, F.greatest(voltage + step, F.lit(0.0))).otherwise(voltage)


def gain_step(voltage: Column, target: Column, peak: Column, alpha: float, max_step: float, tolerance: float) -> tuple[Column, Column]:
    """The new voltage, null where none is set, and why: no fit, peak too low, converged within ``tolerance`` percent of the target, off, or adjusting."""
    status = (
        F.when(peak.isNull(), "FIT FAIL").when(peak <= 1, "PEAK TOO LOW").when(F.abs(peak - target) <= target * (tolerance / 100), "CONVERGED")
        .when(voltage < 1, "HV OFF/ZERO").otherwise("ADJUSTING")
    )
    return F.when(status == "ADJUSTING", gain_update(voltage, target, peak, alpha, max_step)), status


def pole_zero(tau: Column) -> Column:
    """``1 / (e^(1/tau) - 1)``, 0 for a decay constant that is not positive and finite."""
    good = (tau > 0) & ~F.isnan(tau) & (tau != F.lit(float("inf")))
    return F.when(good, 1.0 / (F.exp(1.0 / tau) - 1.0)).otherwise(F.lit(0.0))


def scaled_energy(charge: Column, scale: float, offset: float) -> Column:
    """Charge to a 16-bit energy: scaled, shifted, cut to the range; 0 for what is not finite."""
    raw = charge * F.lit(scale) + F.lit(offset)
    finite = raw.isNotNull() & ~F.isnan(raw) & (F.abs(raw) != F.lit(float("inf")))
    return F.when(finite, F.least(F.greatest(raw, F.lit(0.0)), F.lit(65535.0))).otherwise(F.lit(0.0)).cast("int")


def samples_of(ns: float, ns_per_sample: float) -> int:
    """Nanoseconds in whole samples, one at least."""
    return max(1, int(ns / ns_per_sample + 0.5))
