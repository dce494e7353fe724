"""Histograms as sparse ``(key, bin, count)`` rows, rebinning, peaks and time calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import range_join


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin of a value in single precision: -1 below ``low``, ``bins`` at or above ``high`` and for null, as in SQL."""
    v, lo, hi = value.cast("float"), F.lit(low).cast("float"), F.lit(high).cast("float")
    width = F.lit((high - low) / bins).cast("float")
    at = ((v - lo) / width).cast("float").cast("int")
    return F.when(v < lo, F.lit(-1)).when(v >= hi, F.lit(bins)).otherwise(F.least(at, F.lit(bins)))


def hist1d(rows: DataFrame, keys: list[str], value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Counts by ``keys`` and ``bin``; bin -1 is the underflow and bin ``bins`` the overflow, nulls with it; rows that shall not count are filtered before."""
    filled = rows.withColumn("bin", bin_of(value, low, high, bins))
    return filled.groupBy(*keys, "bin").agg(F.count("*").alias("counts"))


def hist2d(rows: DataFrame, keys: list[str], x: Column, y: Column, xs: tuple, ys: tuple) -> DataFrame:
    """Counts by flat bin ``y_bin * x_bins + x_bin``; -1 where either axis is out of range. In-range bins clamp to the last."""
    (x_low, x_high, nx), (y_low, y_high, ny) = xs, ys
    bx, by = bin_of(x, x_low, x_high, nx), bin_of(y, y_low, y_high, ny)
    inside = (x.cast("float") >= x_low) & (x.cast("float") < x_high) & (y.cast("float") >= y_low) & (y.cast("float") < y_high)
    flat = F.when(inside, F.least(by, F.lit(ny - 1)) * nx + F.least(bx, F.lit(nx - 1))).otherwise(F.lit(-1))
    kept = rows.withColumn("bin", F.when(x.isNotNull() & y.isNotNull(), flat)).filter("bin is not null")
    return kept.groupBy(*keys, "bin").agg(F.count("*").alias("counts"))


def summary(hist: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Total, underflow and overflow of sparse histograms."""
    return hist.groupBy(*keys).agg(
        F.sum("counts").alias("total"), F.sum(F.when(F.col("bin") < 0, F.col("counts")).otherwise(0)).alias("underflow"),
        F.sum(F.when(F.col("bin") >= bins, F.col("counts")).otherwise(0)).alias("overflow"),
    )


def dense(hist: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """One row per key with ``counts`` of every bin in order."""
    slots = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    grid = hist.select(*keys).distinct().select(*keys, slots)
    full = grid.join(hist, [*keys, "bin"], "left").select(*keys, F.struct("bin", F.coalesce("counts", F.lit(0)).alias("c")).alias("s"))
    return full.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["c"]).alias("counts"))


def registered(hist: DataFrame, channels: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of registered and of observed channels; 0 for a registered one without hits."""
    totals = hist.groupBy(*keys).agg(F.sum("counts").alias("total"))
    return channels.select(*keys).distinct().join(totals, keys, "full").select(*keys, F.coalesce("total", F.lit(0)).alias("total"))


def rebin1d(hist: DataFrame, keys: list[str], native: tuple, user: tuple) -> DataFrame:
    """Native bins dealt to user bins by their centres; what falls out joins the native under- and overflow."""
    (n_low, n_high, n_bins), (low, high, bins) = native, user
    bins = min(bins, n_bins)
    centre = F.lit(n_low) + (F.col("bin") + 0.5) * F.lit((n_high - n_low) / n_bins)
    at = F.floor((centre - F.lit(low)) / F.lit((high - low) / bins)).cast("int")
    to = F.when(F.col("bin") < 0, -1).when(F.col("bin") >= n_bins, bins).when(centre < low, -1).when(centre >= high, bins).otherwise(F.least(at, F.lit(bins - 1)))
    return hist.withColumn("bin", to.cast("int")).groupBy(*keys, "bin").agg(F.sum("counts").alias("counts"))


def rebin2d(hist: DataFrame, keys: list[str], native: tuple[tuple, tuple], user: tuple[tuple, tuple]) -> DataFrame:
    """The same on both axes of flat bins; everything outside becomes bin -1."""
    (nx, ny), (ux, uy) = native, user
    flat = hist.withColumn("_x", F.col("bin") % nx[2]).withColumn("_y", F.expr(f"bin div {nx[2]}"))

    def axis(col: str, n: tuple, u: tuple) -> Column:
        bins = min(u[2], n[2])
        centre = F.lit(n[0]) + (F.col(col) + 0.5) * F.lit((n[1] - n[0]) / n[2])
        at = F.floor((centre - F.lit(u[0])) / F.lit((u[1] - u[0]) / bins)).cast("int")
        return F.when((centre >= u[0]) & (centre < u[1]), F.least(at, F.lit(bins - 1)))

    x, y = axis("_x", nx, ux), axis("_y", ny, uy)
    to = F.when((F.col("bin") >= 0) & x.isNotNull() & y.isNotNull(), y * min(ux[2], nx[2]) + x).otherwise(F.lit(-1)).cast("int")
    return flat.withColumn("bin", to).groupBy(*keys, "bin").agg(F.sum("counts").alias("counts"))


def time_differences(hits: DataFrame, reference: Column, gate: Column, window: float) -> DataFrame:
    """``module, channel, dt`` of every hit off the reference channel within ``window`` of a gated reference hit."""
    w = F.lit(float(window))
    triggers = hits.filter(reference & gate).select(F.col("timestamp_ns").alias("t0"), (F.col("timestamp_ns") - w).alias("lo"), (F.col("timestamp_ns") + w).alias("hi"))
    others = hits.filter(~reference).select("module", "channel", "timestamp_ns")
    return range_join(triggers, others, "lo", "hi", "timestamp_ns", 2 * window).select("module", "channel", (F.col("timestamp_ns") - F.col("t0")).alias("dt"))


def dt_hist(pairs: DataFrame, keys: list[str], low: float, high: float, width: float) -> DataFrame:
    """Counts of ``dt`` in ``[low, high)``; ``dt = high`` falls out, entries are in-range only."""
    bins = -int(-(high - low) // width)
    at = F.floor((F.col("dt") - F.lit(low)) / F.lit(width)).cast("int")
    return pairs.filter(F.col("dt") >= low).withColumn("bin", at).filter(F.col("bin") < bins).groupBy(*keys, "bin").agg(F.count("*").alias("counts"))


def peaks(hist: DataFrame, keys: list[str], low: float, width: float, bins: int, reach: int = 5) -> DataFrame:
    """Per key: entries, the last of the highest bins, the centroid of ``reach`` bins around it, and its significance.

    The background is the mean over all other bins, empty ones included; without background the significance is infinite.
    """
    rank = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = hist.withColumn("p", F.max(F.struct("counts", "bin")).over(rank)).withColumn("_near", F.abs(F.col("bin") - F.col("p.bin")) <= reach)
    centre = F.lit(low) + (F.col("bin") + 0.5) * F.lit(width)
    rows = top.groupBy(*keys, F.col("p.bin").alias("peak_bin"), F.col("p.counts").alias("peak_counts")).agg(
        F.sum("counts").alias("entries"), F.sum(F.when(F.col("_near"), F.col("counts") * centre)).alias("_wx"),
        F.sum(F.when(F.col("_near"), F.col("counts"))).alias("_w"), F.sum(F.when(~F.col("_near"), F.col("counts")).otherwise(0)).alias("_out"),
    )
    around = F.least(F.col("peak_bin") + reach, F.lit(bins - 1)) - F.greatest(F.col("peak_bin") - reach, F.lit(0)) + 1
    ground = F.when(around < bins, F.col("_out") / (F.lit(bins) - around)).otherwise(0.0)
    excess = F.when(ground > 0, (F.col("peak_counts") - ground) / F.sqrt(ground)).otherwise(F.lit(float("inf")))
    return rows.select(*keys, "entries", "peak_bin", "peak_counts", (F.col("_wx") / F.col("_w")).alias("centroid"), excess.alias("significance"))


def calibration(found: DataFrame, keys: list[str], minimum: int = 100, sigma: float = 5.0) -> DataFrame:
    """Offset of each key: the centroid with enough entries or a significant peak, else 0."""
    sure = (F.col("entries") >= minimum) | (F.col("significance") >= sigma)
    return found.select(*keys, "entries", F.when(sure, F.col("centroid")).otherwise(0.0).alias("offset_ns"))
