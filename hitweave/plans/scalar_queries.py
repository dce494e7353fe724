"""Projections, predicates, calibration and the offset tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.hits import CHANNEL_DIM_SQL, HITS_SQL, OFFSET_TREE, OFFSET_TREE_SQL, channel_dim, hits, offset_tree

KEYS = ["module", "channel"]


def hit_projection(spark, d):
    return hits(spark, d).select("module", "channel", "energy", "energy_short", "timestamp_ns", F.lit(False).alias("with_ac"))


def flag_predicates(spark, d):
    f = F.col("flags")
    return hits(spark, d).agg(*[F.count_if(C.has_flag(f, n)).alias(n) for n in C.FLAGS])


def flag_remap(spark, d):
    raw = (F.col("event_id") * 37 % 65536).cast("int")
    return hits(spark, d).select("event_id", C.remap_flags(raw).alias("flags"))


def adc_min_filter(spark, d):
    return hits(spark, d).groupBy("module").agg(F.count_if(F.col("energy") >= 5000).alias("passed"), F.count_if(F.col("energy") < 5000).alias("dropped"))


def psd_ratio(spark, d):
    return hits(spark, d).select("event_id", F.round(C.psd_ratio(F.col("energy"), F.col("energy_short")), 9).alias("psd"))


def energy_gate(spark, d):
    return hits(spark, d).filter("module = 1 AND channel = 2 AND energy BETWEEN 10000 AND 20000").select("event_id", "energy")


def axis_sources(spark, d):
    """Named axes of every hit, as rows."""
    axes = {"energy": F.col("energy").cast("double"), "energy_short": F.col("energy_short").cast("double"), "user_info0": F.col("flags").cast("double")}
    return hits(spark, d).select("event_id", F.explode(F.array(*[F.struct(F.lit(n).alias("axis"), c.alias("value")) for n, c in axes.items()])).alias("a")).select("event_id", "a.axis", "a.value")


def compare_logic(spark, d):
    e = F.col("energy")
    ops = {"eq": e == 20000, "ne": e != 20000, "lt": e < 20000, "le": e <= 20000, "gt": e > 20000, "ge": e >= 20000, "none": F.lit(False)}
    return hits(spark, d).agg(*[F.count_if(c).alias(n) for n, c in ops.items()])


def timestamp_compose(spark, d):
    n = F.col("event_id")
    hw = C.hardware_time(n % 8, (n * 104729) % (1 << 31), n % 1024, 2.0)
    sw = C.software_time(n * 65537, (n % 16) / 16.0, 4.0)
    return hits(spark, d).select("event_id", hw.alias("hardware_ns"), sw.alias("software_ns"))


def fine_time_fraction(spark, d):
    before, after = (F.col("event_id") * 7919 % 16384).cast("int"), (F.col("event_id") * 104729 % 16384).cast("int")
    signed = [(x - 8192).cast("int") for x in (before, after)]
    return hits(spark, d).select("event_id", F.round(C.psd_fraction(before, after), 9).alias("psd"), F.round(C.pha_fraction(*signed), 9).alias("pha"))


def physics_words(spark, d):
    word = F.col("event_id") * 2654435761 % (1 << 32)
    a, b = C.psd_physics(word), C.pha_physics(word)
    return hits(spark, d).select("event_id", *[c.alias(f"psd_{n}") for n, c in a.items()], *[c.alias(f"pha_{n}") for n, c in b.items()])


def sign_extension(spark, d):
    return hits(spark, d).select("event_id", C.sign_extend((F.col("event_id") * 7919) % 16384).alias("value"))


def rate_format(spark, d):
    rate = F.pow(F.lit(10.0), F.col("event_id") % 8) * 1.5
    return hits(spark, d).select("event_id", C.rate_text(rate).alias("rate"))


def byte_rate_format(spark, d):
    rate = F.pow(F.lit(10.0), F.col("event_id") % 11) * 1.25
    return hits(spark, d).select("event_id", C.byte_rate_text(rate).alias("rate"))


def snap_validate(spark, d):
    v = F.col("energy") / 7.0
    return hits(spark, d).select("event_id", C.snapped(v, 100.0, 5000.0, 25.0).alias("value"), C.snap_status(v, 100.0, 5000.0, 25.0).alias("status"))


def channel_mask(spark, d):
    mask = F.concat(F.lit("0x"), F.hex(F.col("event_id") % 65536))
    on = C.mask_bits(mask, 16)
    return hits(spark, d).select("event_id", F.size(F.filter(on, lambda b: b)).alias("enabled"), C.bits_mask(on).alias("mask"))


def config_overlay(spark, d):
    base = {"threshold": F.lit(100), "gain": F.col("channel") + 1}
    over = {"threshold": F.when(F.col("module") == 1, 250), "gain": F.when(F.col("channel") == 2, 9)}
    merged = C.overlay(base, over)
    return hits(spark, d).select("event_id", *[c.cast("int").alias(n) for n, c in merged.items()])


def offset_tree_resolve(spark, d=None):
    """Absolute offset, root and depth of every channel; a root's own offset counts."""
    return spark.sql("""
        WITH RECURSIVE t(module, channel, root_module, root_channel, offset_ns, depth) AS (
            SELECT module, channel, module, channel, offset_ns, 0 FROM {tree} WHERE ref_module IS NULL
            UNION ALL
            SELECT o.module, o.channel, t.root_module, t.root_channel, t.offset_ns + o.offset_ns, t.depth + 1
            FROM {tree} o JOIN t ON o.ref_module = t.module AND o.ref_channel = t.channel)
        SELECT * FROM t""", tree=offset_tree(spark))


def check_offsets(entries: list[tuple]) -> list[str]:
    """Warnings about an offset forest; raises on double, dangling or cyclic entries."""
    parents = {}
    for module, channel, ref_module, ref_channel, _ in entries:
        if (module, channel) in parents:
            raise ValueError(f"channel {module}:{channel} is listed twice")
        parents[module, channel] = None if ref_module is None else (ref_module, ref_channel)
    deepest = 0
    for start in parents:
        at, seen = start, []
        while parents[at] is not None:
            seen.append(at)
            at = parents[at]
            if at not in parents:
                raise ValueError(f"{start} refers to {at}, which is not listed")
            if at in seen:
                raise ValueError(f"{start} is part of a cycle")
        deepest = max(deepest, len(seen))
    roots = sum(p is None for p in parents.values())
    return ["several roots"] * (roots > 1) + ["deeper than 5"] * (deepest > 5)


def offset_collapse(spark, d=None):
    """All offsets against the smallest root."""
    t = offset_tree_resolve(spark)
    root = t.agg(F.min(F.struct("root_module", "root_channel")).alias("r"))
    return t.join(F.broadcast(root)).select("module", "channel", F.col("r.root_module").alias("ref_module"), F.col("r.root_channel").alias("ref_channel"), "offset_ns")


def time_align(spark, d):
    """Hit times less the offset of their channel; 0 for a channel without one."""
    offsets = offset_tree_resolve(spark).select(*KEYS, "offset_ns")
    rows = hits(spark, d).join(F.broadcast(offsets), KEYS, "left")
    return rows.select("event_id", (F.col("timestamp_ns") - F.coalesce("offset_ns", F.lit(0.0))).alias("aligned_ns"))


def energy_calibration(spark, d):
    """Cubic calibration by channel; the raw value for a channel without one."""
    rows = hits(spark, d).join(F.broadcast(channel_dim(spark)), KEYS, "left")
    made = C.polynomial(F.col("energy").cast("double"), *map(F.col, ("p0", "p1", "p2", "p3")))
    return rows.select("event_id", F.round(F.coalesce(made, F.col("energy").cast("double")), 6).alias("calibrated"))


def channel_tags(spark, d):
    rows = hits(spark, d).join(F.broadcast(channel_dim(spark)), KEYS, "left")
    return rows.filter(F.arrays_overlap("tags", F.array(F.lit("Si"), F.lit("AC")))).groupBy("detector_type").agg(F.count("*").alias("hits"))


def offset_skeleton(spark, d):
    """A flat tree over all observed modules and channels, the first as root."""
    rows = hits(spark, d)
    grid = rows.select("module").distinct().join(rows.select("channel").distinct())
    root = (F.col("module") == 0) & (F.col("channel") == 0)
    return grid.select("module", "channel", F.when(~root, 0).alias("ref_module"), F.when(~root, 0).alias("ref_channel"), F.lit(0.0).alias("offset_ns"))


def legacy_keys(spark, d):
    """Zero-padded channel keys written and read back."""
    key = F.format_string("%02d_%02d", "module", "channel")
    rows = hits(spark, d).select(key.alias("key")).distinct()
    parts = F.split("key", "_")
    return rows.select("key", parts[0].cast("int").alias("module"), parts[1].cast("int").alias("channel"))


def gain_update(spark, d):
    v, peak = F.lit(800.0) + F.col("event_id") % 100, F.col("energy") * 1.0
    return hits(spark, d).select("event_id", F.round(C.gain_update(v, F.lit(20000.0), peak, 7.0, 20.0), 6).alias("voltage"))


QUERIES = {f.__name__: f for f in (
    hit_projection, flag_predicates, flag_remap, adc_min_filter, psd_ratio, energy_gate, axis_sources, compare_logic, timestamp_compose, fine_time_fraction,
    physics_words, sign_extension, rate_format, byte_rate_format, snap_validate, channel_mask, config_overlay, offset_tree_resolve, offset_collapse, time_align,
    energy_calibration, channel_tags, offset_skeleton, legacy_keys, gain_update,
)}

TREE_SQL = f"""{OFFSET_TREE_SQL},
t AS (SELECT module, channel, module AS root_module, channel AS root_channel, offset_ns, 0 AS depth FROM offset_tree WHERE ref_module IS NULL
      UNION ALL SELECT o.module, o.channel, t.root_module, t.root_channel, t.offset_ns + o.offset_ns, t.depth + 1
      FROM offset_tree o JOIN t ON o.ref_module = t.module AND o.ref_channel = t.channel)"""
WORD = "(event_id * 2654435761 % 4294967296)"
ORACLE_SQL = {
    "hit_projection": f"WITH {HITS_SQL} SELECT module, channel, energy, energy_short, timestamp_ns, false AS with_ac FROM hits",
    "flag_predicates": f"WITH {HITS_SQL} SELECT " + ", ".join(f"count(*) FILTER (WHERE flags & {b} <> 0) AS {n}" for n, b in C.FLAGS.items()) + " FROM hits",
    "flag_remap": f"WITH {HITS_SQL}, r AS (SELECT event_id, event_id * 37 % 65536 AS raw FROM hits) SELECT event_id, CAST("
    + " + ".join(f"((raw >> {RB}) & 1) * {C.FLAGS[n]}" for n, RB in C.RAW_BITS.items()) + " AS BIGINT) AS flags FROM r",
    "adc_min_filter": f"WITH {HITS_SQL} SELECT module, count(*) FILTER (WHERE energy >= 5000) AS passed, count(*) FILTER (WHERE energy < 5000) AS dropped FROM hits GROUP BY 1",
    "psd_ratio": f"WITH {HITS_SQL} SELECT event_id, CASE WHEN energy > 0 THEN round((energy - energy_short) / CAST(energy AS DOUBLE), 9) END AS psd FROM hits",
    "energy_gate": f"WITH {HITS_SQL} SELECT event_id, energy FROM hits WHERE module = 1 AND channel = 2 AND energy BETWEEN 10000 AND 20000",
    "axis_sources": f"""WITH {HITS_SQL} SELECT event_id, 'energy' AS axis, CAST(energy AS DOUBLE) AS value FROM hits UNION ALL
        SELECT event_id, 'energy_short', energy_short FROM hits UNION ALL SELECT event_id, 'user_info0', flags FROM hits""",
    "compare_logic": f"WITH {HITS_SQL} SELECT " + ", ".join(f"count(*) FILTER (WHERE energy {o} 20000) AS {n}" for n, o in {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items()) + ", CAST(0 AS BIGINT) AS none FROM hits",
    "timestamp_compose": f"""WITH {HITS_SQL} SELECT event_id, (((event_id % 8) << 31) | (event_id * 104729 % 2147483648)) * 2.0::DOUBLE + (event_id % 1024) * 2.0::DOUBLE / 1024 AS hardware_ns,
        (event_id * 65537) * 4.0::DOUBLE + (event_id % 16) / 16.0::DOUBLE * 4.0::DOUBLE AS software_ns FROM hits""",
    "fine_time_fraction": f"""WITH {HITS_SQL}, x AS (SELECT event_id, CAST(event_id * 7919 % 16384 AS DOUBLE) AS b, CAST(event_id * 104729 % 16384 AS DOUBLE) AS a FROM hits)
        SELECT event_id, round(CASE WHEN a = b THEN 0 ELSE least(greatest((8192 - a) / (b - a), 0), 1) END, 9) AS psd,
               round(CASE WHEN a = b THEN 0 ELSE least(greatest((b - 8192) / (b - a), 0), 1) END, 9) AS pha FROM x""",
    "physics_words": f"""WITH {HITS_SQL} SELECT event_id, ({WORD} >> 16) & 65535 AS psd_energy, ({WORD} >> 15) & 1 AS psd_pileup, {WORD} & 32767 AS psd_energy_short,
        {WORD} & 32767 AS pha_energy, ({WORD} >> 15) & 1 AS pha_pileup, ({WORD} >> 16) & 1023 AS pha_extra FROM hits""",
    "sign_extension": f"WITH {HITS_SQL}, x AS (SELECT event_id, event_id * 7919 % 16384 AS v FROM hits) SELECT event_id, CAST(CASE WHEN v >= 8192 THEN v - 16384 ELSE v END AS INTEGER) AS value FROM x",
    "rate_format": f"""WITH {HITS_SQL}, x AS (SELECT event_id, pow(10.0::DOUBLE, event_id % 8) * 1.5 AS r FROM hits)
        SELECT event_id, CASE WHEN r >= 1e6 THEN printf('%.2f M/s', r / 1e6) WHEN r >= 1e3 THEN printf('%.2f K/s', r / 1e3) ELSE printf('%.0f /s', r) END AS rate FROM x""",
    "byte_rate_format": f"""WITH {HITS_SQL}, x AS (SELECT event_id, pow(10.0::DOUBLE, event_id % 11) * 1.25 AS r FROM hits)
        SELECT event_id, CASE WHEN r >= 1e9 THEN printf('%.2f GB/s', r / 1e9) WHEN r >= 1e6 THEN printf('%.2f MB/s', r / 1e6) WHEN r >= 1e3 THEN printf('%.2f KB/s', r / 1e3)
               ELSE printf('%.0f B/s', round_even(r, 0)) END AS rate FROM x""",
    "snap_validate": f"""WITH {HITS_SQL}, x AS (SELECT event_id, energy / 7.0::DOUBLE AS v FROM hits),
        y AS (SELECT *, least(greatest(100 + floor((v - 100) / 25 + 0.5) * 25, 100), 5000)::DOUBLE AS s FROM x) SELECT event_id, s AS value, CASE WHEN s = v THEN 'ok' ELSE 'adjusted' END AS status FROM y""",
    "channel_mask": f"WITH {HITS_SQL} SELECT event_id, CAST(bit_count(event_id % 65536) AS INTEGER) AS enabled, '0x' || lower(printf('%x', event_id % 65536)) AS mask FROM hits",
    "config_overlay": f"""WITH {HITS_SQL} SELECT event_id, CAST(CASE WHEN module = 1 THEN 250 ELSE 100 END AS INTEGER) AS threshold,
        CAST(CASE WHEN channel = 2 THEN 9 ELSE channel + 1 END AS INTEGER) AS gain FROM hits""",
    "offset_tree_resolve": f"WITH RECURSIVE {TREE_SQL} SELECT * FROM t",
    "offset_collapse": f"WITH RECURSIVE {TREE_SQL} SELECT module, channel, CAST(0 AS INTEGER) AS ref_module, CAST(0 AS INTEGER) AS ref_channel, offset_ns FROM t",
    "time_align": f"WITH RECURSIVE {HITS_SQL}, {TREE_SQL} SELECT event_id, timestamp_ns - coalesce(offset_ns, 0) AS aligned_ns FROM hits LEFT JOIN t USING (module, channel)",
    "energy_calibration": f"""WITH {HITS_SQL}, {CHANNEL_DIM_SQL} SELECT event_id, round(coalesce(((p3 * energy + p2) * energy + p1) * energy + p0, CAST(energy AS DOUBLE)), 6) AS calibrated
        FROM hits LEFT JOIN channel_dim USING (module, channel)""",
    "channel_tags": f"""WITH {HITS_SQL}, {CHANNEL_DIM_SQL} SELECT detector_type, count(*) AS hits FROM hits JOIN channel_dim USING (module, channel)
        WHERE list_has_any(tags, ['Si', 'AC']) GROUP BY 1""",
    "offset_skeleton": f"""WITH {HITS_SQL}, g AS (SELECT * FROM (SELECT DISTINCT module FROM hits) CROSS JOIN (SELECT DISTINCT channel FROM hits))
        SELECT module, channel, CAST(CASE WHEN module + channel > 0 THEN 0 END AS INTEGER) AS ref_module, CAST(CASE WHEN module + channel > 0 THEN 0 END AS INTEGER) AS ref_channel, CAST(0 AS DOUBLE) AS offset_ns FROM g""",
    "legacy_keys": f"WITH {HITS_SQL} SELECT DISTINCT printf('%02d_%02d', module, channel) AS key, module, channel FROM hits",
    "gain_update": f"""WITH {HITS_SQL}, x AS (SELECT event_id, 800.0::DOUBLE + event_id % 100 AS v, CAST(energy AS DOUBLE) AS p FROM hits)
        SELECT event_id, round(CASE WHEN p > 0 THEN greatest(v + least(greatest(v * pow(20000.0::DOUBLE / p, 1.0::DOUBLE / 7.0::DOUBLE) - v, -20), 20), 0) ELSE v END, 6) AS voltage FROM x""",
}
