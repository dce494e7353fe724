"""Peak fits and searches on histograms, one histogram a group; Levenberg-Marquardt in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA_TO_FWHM = 2.0 * np.sqrt(2.0 * np.log(2.0))


def levenberg(model: Callable, start: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 200, limits: tuple | None = None) -> tuple[np.ndarray, float]:
    """Parameters of least weighted squares, held between ``limits``, and their chi-square."""
    p, damp = start.astype(float).copy(), 1e-3
    cost = float((weight * (y - model(p, x)) ** 2).sum())
    for _ in range(rounds):
        steps = np.maximum(np.abs(p), 1e-3) * 1e-6
        here = model(p, x)
        jac = np.stack([(model(p + h * e, x) - here) / h for h, e in zip(steps, np.eye(len(p)))], axis=1)
        grad, hess = jac.T @ (weight * (y - here)), (jac * weight[:, None]).T @ jac
        trial = p + np.linalg.lstsq(hess + damp * np.diag(np.diag(hess) + 1e-12), grad, rcond=None)[0]
        trial = trial if limits is None else np.clip(trial, *limits)
        new = float((weight * (y - model(trial, x)) ** 2).sum())
        if np.isfinite(new) and new < cost:
            done, p, cost, damp = cost - new < 1e-10 * cost, trial, new, max(damp / 5, 1e-12)
            if done:
                break
        else:
            damp *= 5
            if damp > 1e12:
                break
    return p, cost


def gaussian_on_lines(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Gaussian over a background of a left line, a right line and the chord between them."""
    amplitude, mu, sigma, a, b, c, d = p
    left, right = mu - 2.5 * abs(sigma), mu + 2.5 * abs(sigma)
    chord = (a + b * left) + (x - left) / max(right - left, 1e-9) * ((c + d * right) - (a + b * left))
    ground = np.where(x < left, a + b * x, np.where(x > right, c + d * x, chord))
    return amplitude * np.exp(-0.5 * ((x - mu) / sigma) ** 2) + np.maximum(ground, 0)


def fit_peak(x: np.ndarray, y: np.ndarray) -> dict | None:
    """Gaussian peak on a piecewise linear background; null below ten bins or without counts."""
    if len(x) < 10 or y.max() <= 0:
        return None
    top, edge = int(y.argmax()), max(2, len(x) // 8)
    ground = min(y[:edge].mean(), y[-edge:].mean())
    wide = x[y > ground + 0.5 * (y[top] - ground)]
    sigma = max((wide.max() - wide.min()) / SIGMA_TO_FWHM, x[1] - x[0])
    start = np.array([y[top] - ground, x[top], sigma, y[:edge].mean(), 0.0, y[-edge:].mean(), 0.0])
    p, chi2 = levenberg(gaussian_on_lines, start, x, y, 1 / np.maximum(y, 1))
    sigma = abs(p[2])
    return {"amplitude": p[0], "mu": p[1], "sigma": sigma, "fwhm": SIGMA_TO_FWHM * sigma, "area": p[0] * sigma * np.sqrt(2 * np.pi), "chi2": chi2, "ndf": len(x) - 7}


def fit_peaks(hist: DataFrame, keys: list[str], low: float, width: float, bins: int) -> DataFrame:
    """Fit of each key's histogram of ``bin, counts``; keys without a fit give no row."""
    types = dict(hist.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"{n} double" for n in ("amplitude", "mu", "sigma", "fwhm", "area", "chi2")] + ["ndf int"])
    names = [s.split()[0] for s in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.zeros(bins)
        y[pdf["bin"].to_numpy()] = pdf["counts"].to_numpy()
        found = fit_peak(low + (np.arange(bins) + 0.5) * width, y)
        return pd.DataFrame([] if found is None else [{k: pdf[k].iloc[0] for k in keys} | found], columns=names)

    return hist.filter(f"bin between 0 and {bins - 1}").groupBy(*keys).applyInPandas(run, schema)


def gaussian_on_constant(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    return p[0] * np.exp(-0.5 * ((x - p[1]) / p[2]) ** 2) + p[3]


def clipped_moments(x: np.ndarray, y: np.ndarray, rounds: int = 4) -> tuple[float, float, float, float]:
    """Height, centre and spread of the counts above the ground around the fullest five bins, and the ground, the lower quintile.

    Each round takes the moments of what lies within two and a half spreads of the centre found so far.
    """
    ground = float(np.quantile(y, 0.2))
    above = np.clip(y - ground, 0, None)
    centre, spread = x[np.convolve(above, np.ones(min(5, len(y))), "same").argmax()], len(y) / 5
    for _ in range(rounds):
        weight = np.where(np.abs(x - centre) <= 2.5 * spread, above, 0)
        if weight.sum() <= 0:
            break
        centre = float(np.average(x, weights=weight))
        spread = max(float(np.sqrt(np.average((x - centre) ** 2, weights=weight))), 0.5)
    return float(above.max()), centre, spread, ground


def fit_region(y: np.ndarray, low: int, least: float) -> dict:
    """Gaussian on a constant over bins from ``low`` on, by least squares without weights; ``status`` tells why there is no fit.

    Limits: an amplitude to ten times the greatest count, a centre inside the bins, a sigma from half a bin to all bins, a ground of 0 or more.
    """
    if y.sum() < least:
        return {"status": "too few counts"}
    x = np.arange(low, low + len(y), dtype=float)
    limits = np.array([[0, 10 * y.max()], [low, low + len(y)], [0.5, len(y)], [0, np.inf]], float).T
    p, _ = levenberg(gaussian_on_constant, np.clip(clipped_moments(x, y), *limits), x, y, np.ones(len(y)), limits=tuple(limits))
    if not np.isfinite(p).all():
        return {"status": "no fit"}
    off = y - gaussian_on_constant(p, x)
    chi2 = float((off**2 / np.where(y > 0, y, 1)).sum())
    return dict(zip(("amplitude", "mu", "sigma", "ground"), p)) | {"chi2_ndf": chi2 / max(len(y) - 4, 1), "status": "ok"}


def fit_regions(hist: DataFrame, keys: list[str], low: int, high: int, least: float = 1000) -> DataFrame:
    """:func:`fit_region` of bins ``low`` to below ``high`` of each key's histogram; a key without counts there has too few."""
    if not 0 <= low < high:
        raise ValueError(f"no region from {low} to {high}")
    types, values = dict(hist.dtypes), ("amplitude", "mu", "sigma", "ground", "chi2_ndf")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.zeros(high - low)
        inside = pdf[pdf["bin"].between(low, high - 1)]
        y[inside["bin"].to_numpy() - low] = inside["counts"].to_numpy()
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | fit_region(y, low, least)], columns=[*keys, *values, "status"])

    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"{v} double" for v in values] + ["status string"])
    return hist.groupBy(*keys).applyInPandas(run, schema)


def scan_channels(hist: DataFrame, keys: list[str], bins: int, least: int = 100, margin: int = 50, **search) -> DataFrame:
    """Counts of each key, its strongest peak and the region around it; both null below ``least`` counts or without a peak."""
    totals = hist.groupBy(*keys).agg(F.sum("counts").alias("total"))
    enough = hist.join(totals.filter(F.col("total") >= least), keys, "left_semi")
    peaks = search_peaks(enough, keys, bins, **search).filter("rank = 0").select(*keys, F.col("position").alias("peak"))
    low, high = F.greatest(F.lit(0), F.col("peak") - margin), F.least(F.lit(bins - 1), F.col("peak") + margin)
    region = [F.when(F.col("peak").isNotNull(), c).alias(n) for n, c in (("region_low", low), ("region_high", high))]
    return totals.join(peaks, keys, "left").select(*keys, "total", "peak", *region)


def find_peaks(y: np.ndarray, height: float, distance: int, prominence: float, skip: int) -> list[tuple[int, float]]:
    """``(position, height)`` of local maxima past the first ``skip`` bins, which count for nothing, the highest first.

    A plateau counts at its middle; a lower peak nearer than ``distance`` goes, of equal ones the earlier.
    """
    y = y[skip:]
    begin = np.flatnonzero(np.diff(y, prepend=np.nan))  # of runs of equal values
    end = np.append(begin[1:], len(y)) - 1
    v = y[begin]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:]) & (v[1:-1] >= height)) + 1
    kept: list[int] = []
    for i in sorted(((begin[top] + end[top]) // 2).tolist(), key=lambda i: (-y[i], -i)):
        if all(abs(i - k) >= distance for k in kept):
            kept.append(i)
    out = []
    for i in kept:
        higher = np.flatnonzero(y > y[i])
        left, right = higher[higher < i], higher[higher > i]
        base = max(y[(left[-1] if len(left) else 0) : i + 1].min(), y[i : (right[0] if len(right) else len(y) - 1) + 1].min())
        if y[i] - base >= prominence:
            out.append((i + skip, float(y[i])))
    return out


def search_peaks(hist: DataFrame, keys: list[str], bins: int, height: float = 100, distance: int = 50, prominence: float = 30, skip: int = 10) -> DataFrame:
    """Rows ``rank, position, height`` of each key's peaks."""
    types = dict(hist.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.zeros(bins)
        y[pdf["bin"].to_numpy()] = pdf["counts"].to_numpy()
        rows = [{k: pdf[k].iloc[0] for k in keys} | {"rank": r, "position": i, "height": h} for r, (i, h) in enumerate(find_peaks(y, height, distance, prominence, skip))]
        return pd.DataFrame(rows, columns=[*keys, "rank", "position", "height"])

    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["rank int", "position int", "height double"])
    return hist.filter(f"bin between 0 and {bins - 1}").groupBy(*keys).applyInPandas(run, schema)
