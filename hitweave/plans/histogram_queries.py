"""Histograms, time calibration and nearest partners over the hit view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import histograms as H
from ..operators.ordered import nearest
from ..sources.hits import HITS_SQL, channel_dim, hits, table
from ..sources.settings import fill, histogram_specs

ENERGY = (0.0, 65536.0, 256)
PSD = (-1.0, 2.0, 150)
W = 600e9
KEYS = ["module", "channel"]


def psd():
    """Share of the late charge, in single precision; null without charge."""
    return F.when(F.col("energy") > 0, ((F.col("energy") - F.col("energy_short")).cast("float") / F.col("energy").cast("float")).cast("float"))


def hist1d_energy(spark, d):
    return H.hist1d(hits(spark, d), KEYS, F.col("energy"), *ENERGY)


def hist1d_psd(spark, d):
    return H.hist1d(hits(spark, d).filter("energy > 0"), KEYS, psd(), *PSD)


def hist_summary(spark, d):
    return H.summary(H.hist1d(hits(spark, d), KEYS, F.col("energy"), 1000.0, 30000.0, 100), KEYS, 100)


def hist2d_energy_psd(spark, d):
    return H.hist2d(hits(spark, d), ["module"], F.col("energy"), psd(), (0.0, 40000.0, 64), (0.0, 1.0, 32))


def hist_dispatch(spark, d):
    """Energy of every hit and pulse shape where there is charge, in one pass."""
    rows = hits(spark, d).select(*KEYS, F.explode(F.array(
        F.struct(F.lit("energy").alias("kind"), H.bin_of(F.col("energy"), *ENERGY).alias("bin")),
        F.struct(F.lit("psd").alias("kind"), F.when(F.col("energy") > 0, H.bin_of(psd(), *PSD)).alias("bin")),
    )).alias("v"))
    return rows.filter("v.bin is not null").groupBy(*KEYS, "v.kind", "v.bin").agg(F.count("*").alias("counts"))


def hist_dense(spark, d):
    found = H.dense(H.hist1d(hits(spark, d), ["module"], F.col("energy"), 0.0, 50000.0, 20).filter("bin between 0 and 19"), ["module"], 20)
    return found.select("module", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


def hist_registered(spark, d):
    rows = H.hist1d(hits(spark, d), KEYS, F.col("energy"), *ENERGY)
    return H.registered(rows, channel_dim(spark), KEYS)


def hist_rebin1d(spark, d):
    return H.rebin1d(hist1d_energy(spark, d), KEYS, ENERGY, (1000.0, 41000.0, 50))


def hist_rebin2d(spark, d):
    return H.rebin2d(hist2d_energy_psd(spark, d), ["module"], ((0.0, 40000.0, 64), (0.0, 1.0, 32)), ((5000.0, 30000.0, 10), (0.1, 0.9, 8)))


def hist_big(spark, d):
    """Energy histograms of the line items, for load."""
    rows = table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 8).cast("int").alias("module"), (F.col("l_linenumber") - 1).cast("int").alias("channel"),
        (F.floor("l_extendedprice").cast("long") % 65536).cast("int").alias("energy"),
    )
    return H.hist1d(rows, KEYS, F.col("energy"), *ENERGY)


def standard_spectra(spark, d):
    """Per-channel spectra of modules below 3 and channels below 16, in bins of 100."""
    return H.hist1d(hits(spark, d).filter("module < 3 and channel < 16"), KEYS, F.col("energy"), 0.0, 50000.0, 500)


def standard_spectra_16(spark, d):
    """Per-channel spectra of modules below 3 and channels below 16, as the reference draws them."""
    return H.hist1d(hits(spark, d).filter("module < 3 and channel < 16"), KEYS, F.col("energy"), 0.0, 32000.0, 32000)


def standard_spectra_totals(spark, d):
    """Energy, short-gate energy, channel and module histograms of all hits."""
    rows = hits(spark, d).select(F.explode(F.array(
        F.struct(F.lit("energy").alias("kind"), H.bin_of(F.col("energy"), 0.0, 65536.0, 4096).alias("bin")),
        F.struct(F.lit("energy_short").alias("kind"), H.bin_of(F.col("energy_short"), 0.0, 65536.0, 4096).alias("bin")),
        F.struct(F.lit("channel").alias("kind"), H.bin_of(F.col("channel"), 0.0, 64.0, 64).alias("bin")),
        F.struct(F.lit("module").alias("kind"), H.bin_of(F.col("module"), 0.0, 32.0, 32).alias("bin")),
    )).alias("v"))
    return rows.groupBy("v.kind", "v.bin").agg(F.count("*").alias("counts"))


def hist_registered_all(spark, d):
    """Hits of all registered or observed channels."""
    return H.registered(hist1d_energy(spark, d), channel_dim(spark), KEYS)


def log_heatmap(spark, d):
    rows = hist2d_energy_psd(spark, d).filter("bin >= 0").groupBy("bin").agg(F.sum("counts").alias("counts"))
    return rows.select("bin", F.round(F.log10("counts"), 6).alias("level"))


def viewer_hist2d(spark, d):
    """Two-axis counts whose out-of-range hits are ignored and which stop at 2^32 - 1."""
    rows = H.hist2d(hits(spark, d), [], F.col("energy"), F.col("energy_short"), (0.0, 40000.0, 40), (0.0, 30000.0, 30)).filter("bin >= 0")
    return rows.select("bin", F.least("counts", F.lit((1 << 32) - 1)).alias("counts"))


def _pairs(spark, d):
    reference = (F.col("module") == 0) & (F.col("channel") == 0)
    return H.time_differences(hits(spark, d), reference, F.col("energy").between(5000, 40000), W)


def dt_hist(spark, d):
    return H.dt_hist(_pairs(spark, d), KEYS, -W, W, 20e9)


def _peaks(spark, d):
    return H.peaks(dt_hist(spark, d), KEYS, -W, 20e9, 60)


def dt_peak(spark, d):
    return _peaks(spark, d).select(*KEYS, "entries", "peak_bin", "peak_counts")


def dt_centroid(spark, d):
    return _peaks(spark, d).select(*KEYS, F.round("centroid", 3).alias("centroid"))


def dt_significance(spark, d):
    return _peaks(spark, d).select(*KEYS, F.round("significance", 6).alias("significance"))


def dt_calibration(spark, d):
    found = H.calibration(_peaks(spark, d), KEYS, 80, 2.0)
    return found.select(*KEYS, "entries", F.round("offset_ns", 3).alias("offset_ns"))


def time_alignment_topk(spark, d):
    """The twelve channels of most entries."""
    return dt_peak(spark, d).orderBy(F.desc("entries"), *KEYS).limit(12).select(*KEYS, "entries")


def _near(spark, d):
    rows = hits(spark, d)
    left = rows.filter("channel = 0").select("event_id", "module", "energy", "timestamp_ns")
    right = rows.filter("channel = 1").select(F.col("event_id").alias("partner_id"), F.col("energy").alias("partner_energy"), F.col("timestamp_ns").alias("partner_ns"))
    return nearest(left, right, "timestamp_ns", "partner_ns", W, ["partner_id"])


def nearest_partner(spark, d):
    near = _near(spark, d)
    return near.select("event_id", F.col("_near.partner_id").alias("partner_id"), (F.col("_near.partner_ns") - F.col("timestamp_ns")).alias("dt_ns"))


def coinc_hist_gated(spark, d):
    near = _near(spark, d).filter(F.col("energy").between(5000, 45000) & F.col("_near.partner_energy").between(10000, 40000))
    rows = near.select("module", (F.col("_near.partner_ns") - F.col("timestamp_ns")).alias("dt"))
    return H.dt_hist(rows, ["module"], -W, W, 50e9)


#: A histogram list as users write it.
SPECS = """{"histograms": [
    {"name": "spectrum", "type": "TH1D", "fill": "energy", "bins": 100, "min": 0, "max": 50000, "channel": 2},
    {"name": "occupancy", "type": "TH1D", "x": "channel", "xbins": 8, "xmin": 0, "xmax": 8},
    {"name": "charges", "type": "TH2D", "x": "energy", "xbins": 20, "xmin": 0, "xmax": 40000,
     "y": "energy_short", "ybins": 10, "ymin": 0, "ymax": 30000, "energy_range": [1000, 35000]}]}"""


def declarative_histograms(spark, d):
    specs, errors = histogram_specs(SPECS)
    if errors:
        raise ValueError("; ".join(errors))
    return fill(hits(spark, d), specs)


QUERIES = {f.__name__: f for f in (
    hist1d_energy, hist1d_psd, hist_summary, hist2d_energy_psd, hist_dispatch, hist_dense, hist_registered, hist_rebin1d, hist_rebin2d, hist_big,
    standard_spectra, standard_spectra_16, standard_spectra_totals, hist_registered_all, log_heatmap, viewer_hist2d, dt_hist, dt_peak, dt_centroid, dt_significance, dt_calibration, time_alignment_topk,
    nearest_partner, coinc_hist_gated, declarative_histograms,
)}


def _bin(v: str, low: float, high: float, bins: int) -> str:
    lo, width = f"CAST({low} AS FLOAT)", f"CAST({(high - low) / bins!r} AS FLOAT)"
    f = f"CAST({v} AS FLOAT)"
    return f"CASE WHEN {f} < {lo} THEN -1 WHEN {f} >= CAST({high} AS FLOAT) THEN {bins} ELSE least(CAST(trunc(({f} - {lo}) / {width}) AS INTEGER), {bins}) END"


PSD_EXPR = "CASE WHEN energy > 0 THEN CAST(energy - energy_short AS FLOAT) / CAST(energy AS FLOAT) END"


def _hist(source: str, keys: str, v: str, low: float, high: float, bins: int, where: str = "true") -> str:
    return f"SELECT {keys}, CAST({_bin(v, low, high, bins)} AS INTEGER) AS bin, count(*) AS counts FROM {source} WHERE {where} GROUP BY ALL"


def _hist2(keys: str, x: str, y: str, xs: tuple, ys: tuple) -> str:
    k = keys + ", " if keys else ""
    return f"""SELECT {k}CAST(CASE WHEN CAST({x} AS FLOAT) >= {xs[0]} AND CAST({x} AS FLOAT) < {xs[1]} AND CAST({y} AS FLOAT) >= CAST({ys[0]} AS FLOAT) AND CAST({y} AS FLOAT) < CAST({ys[1]} AS FLOAT)
        THEN least({_bin(y, *ys)}, {ys[2] - 1}) * {xs[2]} + least({_bin(x, *xs)}, {xs[2] - 1}) ELSE -1 END AS INTEGER) AS bin, count(*) AS counts
        FROM (SELECT *, {PSD_EXPR} AS psd FROM hits) WHERE {y} IS NOT NULL GROUP BY ALL"""


PAIRS_SQL = f"""{HITS_SQL},
pairs AS (SELECT h.module, h.channel, h.timestamp_ns - t.timestamp_ns AS dt FROM hits t JOIN hits h ON t.module = 0 AND t.channel = 0 AND t.energy BETWEEN 5000 AND 40000
    AND NOT (h.module = 0 AND h.channel = 0) AND h.timestamp_ns BETWEEN t.timestamp_ns - 600e9::DOUBLE AND t.timestamp_ns + 600e9::DOUBLE),
dth AS (SELECT module, channel, CAST(floor((dt + 600e9::DOUBLE) / 20e9::DOUBLE) AS INTEGER) AS bin, count(*) AS counts FROM pairs WHERE dt < 600e9 GROUP BY ALL)"""
PEAKS_SQL = f"""{PAIRS_SQL},
top AS (SELECT *, first_value(bin) OVER w AS pb, first_value(counts) OVER w AS pc FROM dth WINDOW w AS (PARTITION BY module, channel ORDER BY counts DESC, bin DESC)),
agg AS (SELECT module, channel, pb AS peak_bin, pc AS peak_counts, CAST(sum(counts) AS BIGINT) AS entries,
    sum(CASE WHEN abs(bin - pb) <= 5 THEN counts * (-600e9::DOUBLE + (bin + 0.5::DOUBLE) * 20e9::DOUBLE) END) / sum(CASE WHEN abs(bin - pb) <= 5 THEN counts END) AS centroid,
    CAST(sum(CASE WHEN abs(bin - pb) > 5 THEN counts ELSE 0 END) AS DOUBLE) / (60 - (least(pb + 5, 59) - greatest(pb - 5, 0) + 1)) AS bg FROM top GROUP BY module, channel, pb, pc),
peaks AS (SELECT *, CASE WHEN bg > 0 THEN (peak_counts - bg) / sqrt(bg) ELSE 'inf'::DOUBLE END AS significance FROM agg)"""
NEAR_SQL = f"""{HITS_SQL},
cand AS (SELECT a.event_id, a.module, a.energy, b.event_id AS partner_id, b.energy AS partner_energy, b.timestamp_ns - a.timestamp_ns AS dt_ns,
    row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.timestamp_ns - a.timestamp_ns), b.timestamp_ns, b.event_id) AS rk
    FROM hits a LEFT JOIN hits b ON b.channel = 1 AND b.timestamp_ns BETWEEN a.timestamp_ns - 600e9::DOUBLE AND a.timestamp_ns + 600e9::DOUBLE WHERE a.channel = 0),
near AS (SELECT * FROM cand WHERE rk = 1)"""
NATIVE = _hist("hits", "module, channel", "energy", *ENERGY)
FLAT2 = _hist2("module", "energy", "psd", (0.0, 40000.0, 64), (0.0, 1.0, 32))

ORACLE_SQL = {
    "hist1d_energy": f"WITH {HITS_SQL} {NATIVE}",
    "hist1d_psd": f"WITH {HITS_SQL} {_hist('hits', 'module, channel', PSD_EXPR, *PSD, where='energy > 0')}",
    "hist_summary": f"""WITH {HITS_SQL} SELECT module, channel, count(*) AS total, CAST(sum(CASE WHEN energy < 1000 THEN 1 ELSE 0 END) AS BIGINT) AS underflow,
        CAST(sum(CASE WHEN energy >= 30000 THEN 1 ELSE 0 END) AS BIGINT) AS overflow FROM hits GROUP BY ALL""",
    "hist2d_energy_psd": f"WITH {HITS_SQL} {FLAT2}",
    "hist_dispatch": f"""WITH {HITS_SQL}, e AS ({NATIVE}), p AS ({_hist('hits', 'module, channel', PSD_EXPR, *PSD, where='energy > 0')})
        SELECT 'energy' AS kind, * FROM e UNION ALL SELECT 'psd', * FROM p""",
    "hist_dense": f"""WITH {HITS_SQL}, b AS (SELECT module, CAST(energy // 2500 AS INTEGER) AS bin, count(*) AS c FROM hits WHERE energy < 50000 GROUP BY ALL),
        g AS (SELECT DISTINCT module, k AS bin FROM b, range(20) r(k))
        SELECT module, string_agg(CAST(coalesce(c, 0) AS VARCHAR), ',' ORDER BY bin) AS counts FROM g LEFT JOIN b USING (module, bin) GROUP BY module""",
    "hist_registered": f"""WITH {HITS_SQL}, o AS (SELECT module, channel, count(*) AS total FROM hits GROUP BY ALL),
        c AS (SELECT CAST(g // 5 AS INTEGER) AS module, CAST(g % 5 AS INTEGER) AS channel FROM range(19) r(g))
        SELECT module, channel, coalesce(total, 0) AS total FROM c FULL JOIN o USING (module, channel)""",
    "hist_rebin1d": f"""WITH {HITS_SQL}, n AS ({NATIVE}), c AS (SELECT *, (bin + 0.5::DOUBLE) * 256 AS x FROM n)
        SELECT module, channel, CAST(CASE WHEN bin < 0 THEN -1 WHEN bin >= 256 THEN 50 WHEN x < 1000 THEN -1 WHEN x >= 41000 THEN 50
            ELSE least(floor((x - 1000) / 800), 49) END AS INTEGER) AS bin, CAST(sum(counts) AS BIGINT) AS counts FROM c GROUP BY ALL""",
    "hist_rebin2d": f"""WITH {HITS_SQL}, n AS ({FLAT2}), c AS (SELECT *, (bin % 64 + 0.5::DOUBLE) * 625 AS x, (bin // 64 + 0.5::DOUBLE) / 32 AS y FROM n)
        SELECT module, CAST(CASE WHEN bin >= 0 AND x >= 5000 AND x < 30000 AND y >= 0.1::DOUBLE AND y < 0.9::DOUBLE
            THEN least(floor((y - 0.1::DOUBLE) / ((0.9::DOUBLE - 0.1::DOUBLE) / 8)), 7) * 10 + least(floor((x - 5000) / 2500), 9) ELSE -1 END AS INTEGER) AS bin,
            CAST(sum(counts) AS BIGINT) AS counts FROM c GROUP BY ALL""",
    "hist_big": f"""WITH big AS (SELECT CAST(l_suppkey % 8 AS INTEGER) AS module, CAST(l_linenumber - 1 AS INTEGER) AS channel,
            CAST(CAST(floor(l_extendedprice) AS BIGINT) % 65536 AS INTEGER) AS energy FROM lineitem) {_hist('big', 'module, channel', 'energy', *ENERGY)}""",
    "standard_spectra": f"WITH {HITS_SQL} {_hist('hits', 'module, channel', 'energy', 0.0, 50000.0, 500, 'module < 3 AND channel < 16')}",
    "standard_spectra_16": f"WITH {HITS_SQL} {_hist('hits', 'module, channel', 'energy', 0.0, 32000.0, 32000, 'module < 3 AND channel < 16')}",
    "standard_spectra_totals": f"""WITH {HITS_SQL} {_hist('hits', "'energy' AS kind", 'energy', 0.0, 65536.0, 4096)} UNION ALL {_hist('hits', "'energy_short' AS kind", 'energy_short', 0.0, 65536.0, 4096)}
        UNION ALL {_hist('hits', "'channel' AS kind", 'channel', 0.0, 64.0, 64)} UNION ALL {_hist('hits', "'module' AS kind", 'module', 0.0, 32.0, 32)}""",
    "hist_registered_all": f"""WITH {HITS_SQL}, o AS (SELECT module, channel, count(*) AS total FROM hits GROUP BY ALL),
        c AS (SELECT CAST(g // 5 AS INTEGER) AS module, CAST(g % 5 AS INTEGER) AS channel FROM range(19) r(g))
        SELECT module, channel, coalesce(total, 0) AS total FROM c FULL JOIN o USING (module, channel)""",
    "log_heatmap": f"WITH {HITS_SQL}, n AS ({FLAT2}) SELECT bin, round(log10(sum(counts)), 6) AS level FROM n WHERE bin >= 0 GROUP BY bin",
    "viewer_hist2d": f"WITH {HITS_SQL}, n AS ({_hist2('', 'energy', 'energy_short', (0.0, 40000.0, 40), (0.0, 30000.0, 30))}) SELECT bin, least(counts, 4294967295) AS counts FROM n WHERE bin >= 0",
    "dt_hist": f"WITH {PAIRS_SQL} SELECT * FROM dth",
    "dt_peak": f"WITH {PEAKS_SQL} SELECT module, channel, entries, peak_bin, peak_counts FROM peaks",
    "dt_centroid": f"WITH {PEAKS_SQL} SELECT module, channel, round(centroid, 3) AS centroid FROM peaks",
    "dt_significance": f"WITH {PEAKS_SQL} SELECT module, channel, round(significance, 6) AS significance FROM peaks",
    "dt_calibration": f"""WITH {PEAKS_SQL} SELECT module, channel, entries, round(CASE WHEN entries >= 80 OR significance >= 2 THEN centroid ELSE 0 END, 3) AS offset_ns FROM peaks""",
    "time_alignment_topk": f"WITH {PEAKS_SQL} SELECT module, channel, entries FROM peaks ORDER BY entries DESC, module, channel LIMIT 12",
    "nearest_partner": f"WITH {NEAR_SQL} SELECT event_id, partner_id, dt_ns FROM near",
    "coinc_hist_gated": f"""WITH {NEAR_SQL} SELECT module, CAST(floor((dt_ns + 600e9::DOUBLE) / 50e9::DOUBLE) AS INTEGER) AS bin, count(*) AS counts FROM near
        WHERE energy BETWEEN 5000 AND 45000 AND partner_energy BETWEEN 10000 AND 40000 AND dt_ns < 600e9 GROUP BY ALL""",
    "declarative_histograms": f"""WITH {HITS_SQL}, gated AS (SELECT * FROM hits WHERE energy BETWEEN 1000 AND 35000)
        SELECT 'spectrum' AS name, * FROM ({_hist("(SELECT * FROM hits WHERE channel = 2)", "module", "energy", 0.0, 50000.0, 100).replace("module, ", "")})
        UNION ALL SELECT 'occupancy', * FROM ({_hist("hits", "module", "channel", 0.0, 8.0, 8).replace("module, ", "")})
        UNION ALL SELECT 'charges', * FROM ({_hist2("", "energy", "energy_short", (0.0, 40000.0, 20), (0.0, 30000.0, 10)).replace("FROM hits", "FROM gated")})""",
}
