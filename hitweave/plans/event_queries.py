"""Triggers, event building and event filters over the hit view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.events import ORDER, Filter, Trigger, ac_hits, anchors, build_events, build_priority, event_hits, event_lists, filter_members, number_kept, priorities, slices
from ..sources.hits import CHANNEL_DIM_SQL, HITS_SQL, hits

W = 60e9
#: Click channels 0 of all modules as plain trigger.
CLICK = [Trigger(f"m{m}", "channel", module=m, channel=0) for m in range(4)] + [Trigger("any", "or", inputs=tuple(f"m{m}" for m in range(4)))]
TAGS = {(m, c): ({"E", "Si"} if c == 0 else {"dE", "Si"} if c == 1 else {("AC", "PMT", "Other")[c - 2]}) for m in range(4) for c in range(5) if (m, c) != (3, 4)}
AC_PAIRS = {(m, 0): (m, 2) for m in range(4)}
LISTED = [Trigger(f"c{m}{c}", "channel", module=m, channel=c) for m in range(4) for c in range(3)]
MANY = [*LISTED, Trigger("many", "multiplicity", inputs=tuple(t.name for t in LISTED), minimum=3, window_ns=300e9)]
BOTH = [Trigger("a", "channel", module=1, channel=0), Trigger("b", "channel", module=2, channel=1), Trigger("both", "and", inputs=("a", "b"), window_ns=900e9)]


def _hits(spark, d):
    return hits(spark, d)


def _events(spark, d):
    rows = hits(spark, d)
    return build_events(anchors(rows, CLICK, "any", W), W), rows


def _members(spark, d):
    events, rows = _events(spark, d)
    return event_hits(events, rows, W)


def l1_or_anchor(spark, d):
    return anchors(hits(spark, d), CLICK, "any", W).select("event_id", "module", "channel", "timestamp_ns")


def l1_module_anchor(spark, d):
    return anchors(hits(spark, d), [Trigger("m2", "module", module=2, channels=3)], "m2", W).select("event_id", "module", "channel")


def l1_multiplicity(spark, d):
    return anchors(hits(spark, d), MANY, "many", W).select("event_id", "module", "channel", "timestamp_ns")


def l1_and(spark, d):
    return anchors(hits(spark, d), BOTH, "both", W).select("event_id", "module", "channel", "timestamp_ns")


def event_build_merge(spark, d):
    members = _members(spark, d)
    keys = ["event_no", "trigger_time", "trigger_module", "trigger_channel", "n_triggers"]
    return members.groupBy(*keys).agg(
        F.count("*").alias("multiplicity"), F.sum("energy").alias("sum_energy"),
        F.min("relative_time").alias("first_ns"), F.max("relative_time").alias("last_ns"),
    )


def event_multiplicity(spark, d):
    return event_build_merge(spark, d).groupBy("multiplicity").agg(F.count("*").alias("events"))


def multiplicity_buckets(spark, d):
    m = F.col("multiplicity")
    name = F.when(m <= 4, m.cast("string")).when(m <= 8, "5-8").when(m <= 16, "9-16").when(m <= 32, "17-32").otherwise(">=33")
    return event_build_merge(spark, d).groupBy(name.alias("bucket")).agg(F.count("*").alias("events"))


def event_hits_flat(spark, d):
    return _members(spark, d).select("event_no", "event_id", "module", "channel", "energy", "energy_short", "relative_time")


def event_build_priority(spark, d):
    rows = hits(spark, d)
    order = priorities(CLICK, "any", W)
    number = F.coalesce(*[F.when((F.col("module") == m) & (F.col("channel") == c), F.lit(p)) for (m, c), p in order.items()])
    found = build_priority(anchors(rows, CLICK, "any", W), rows, 300e9, number, len(order))
    return found.select("event_no", "trigger_time", "trigger_module", "event_id", "relative_time")


def event_with_ac(spark, d):
    return ac_hits(_members(spark, d), AC_PAIRS).select("event_no", "ac_hits", (F.col("ac_hits") > 0).alias("any_ac"))


def event_slices(spark, d):
    rows = slices(hits(spark, d), "timestamp_ns", 0.0, 86_400e9, 3_600e9)
    return rows.groupBy("slice_no").agg(F.count("*").alias("hits"), F.count_if("in_core").alias("core_hits"))


FILTERS = [
    Filter("n_si", "counter", tags=("Si",)), Filter("n_ac", "counter", tags=("AC",)),
    Filter("two_si", "flag", monitor=("n_si",), op=">=", value=2), Filter("no_ac", "flag", monitor=("n_ac",), op="==", value=0),
    Filter("late", "flag", monitor=("n_other",), op="==", value=0), Filter("n_other", "counter", tags=("Other",)), Filter("both", "accept", monitor=("two_si", "no_ac"), logic="AND"),
    Filter("either", "accept", monitor=("two_si", "n_ac"), logic="OR"),
]


def l2_counter_flag_accept(spark, d):
    found = filter_members(_members(spark, d), FILTERS, TAGS)
    return found.select("event_no", "n_si", "n_ac", "two_si", "no_ac", "late", "both", "either", "keep", F.array_join("accepted", ",").alias("accepted"))


def l2_kept_events(spark, d):
    """Kept events alone, numbered after the filters."""
    return number_kept(filter_members(_members(spark, d), FILTERS, TAGS)).select("event_no", "trigger_time", "trigger_module", "multiplicity", "n_si", "n_ac")


def l2_energy_gate(spark, d):
    gate = [Filter("gate", "energy_gate", module=1, channel=0, low=10_000, high=30_000), Filter("ok", "accept", monitor=("gate",))]
    return filter_members(_members(spark, d), gate, TAGS).filter("keep").select("event_no", "multiplicity")


def l2_min_hits(spark, d):
    gate = [Filter("many", "min_hits", value=2), Filter("ok", "accept", monitor=("many",))]
    return filter_members(_members(spark, d), gate, TAGS).filter("keep").select("event_no", "multiplicity")


def l2_ac_veto(spark, d):
    gate = [Filter("veto", "ac_veto", module=1, channel=0, veto_module=2, veto_channel=1, window_ns=50e9), Filter("ok", "accept", monitor=("veto",))]
    return filter_members(_members(spark, d), gate, TAGS).select("event_no", "veto", "keep")


def built_event_arrays(spark, d):
    events, rows = _events(spark, d)
    found = event_lists(events, rows, W, AC_PAIRS, ["module", "channel", "energy", "with_ac"])
    lists = [F.col(f).alias(n) for f, n in (("module", "mod_list"), ("channel", "ch_list"), ("energy", "energy_list"), ("with_ac", "with_ac_list"))]
    return found.select("event_no", "trigger_time", "trigger_module", "trigger_channel", "multiplicity", *lists)


def module_correlation(spark, d):
    rows = _members(spark, d).groupBy("event_no", "trigger_module").agg(*[F.bool_or(F.col("module") == m).alias(f"m{m}") for m in range(4)])
    has = [F.avg(F.col(f"m{m}").cast("double")) for m in range(4)]
    return rows.groupBy("trigger_module").agg(F.count("*").alias("events"), *[F.round(c, 9).alias(f"with_m{m}") for m, c in enumerate(has)])


def first_hits(members):
    """First hit of each channel of each event."""
    rank = F.struct("relative_time", "module", "channel", "energy", "event_id")
    return members.groupBy("event_no", "module", "channel").agg(F.min_by("energy", rank).alias("energy"), F.min(rank).alias("r"))


def anti_diagonal_pairs(spark, d):
    first = first_hits(_members(spark, d))
    a = first.filter("module = 0").select("event_no", F.col("channel").alias("ch_a"), F.col("energy").alias("e_a"))
    b = first.filter("module = 2").select("event_no", (4 - F.col("channel")).alias("ch_a"), F.col("channel").alias("ch_b"), F.col("energy").alias("e_b"))
    return a.join(b, ["event_no", "ch_a"])


def first_hit_pairs(spark, d):
    first = first_hits(_members(spark, d)).withColumn("k", F.struct("r.relative_time", "module", "channel", "energy", "r.event_id"))
    by = first.groupBy("event_no", "module").agg(F.min_by(F.struct("channel", "energy"), "k").alias("h"))
    a = by.filter("module = 0").select("event_no", F.col("h.channel").alias("ch_a"), F.col("h.energy").alias("e_a"))
    b = by.filter("module = 2").select("event_no", F.col("h.channel").alias("ch_b"), F.col("h.energy").alias("e_b"))
    return a.join(b, "event_no")


def pair_fractions(spark, d):
    members = _members(spark, d)
    flags = members.groupBy("event_no").agg(F.bool_or(F.col("module") == 0).alias("a"), F.bool_or(F.col("module") == 2).alias("b"), F.count("*").alias("n"))
    return flags.agg(
        F.count("*").alias("events"), F.count_if(F.col("a") & F.col("b")).alias("pairs"), F.count_if(F.col("n") == 1).alias("single"),
        F.round(100.0 * F.count_if(F.col("a") & F.col("b")) / F.count("*"), 9).alias("pair_percent"),
    )


def pipeline_counters(spark, d):
    events = filter_members(_members(spark, d), FILTERS, TAGS)
    total = hits(spark, d).agg(F.count("*").alias("hits"))
    return events.agg(F.count("*").alias("built"), F.count_if("keep").alias("kept"), F.sum("multiplicity").alias("member_hits")).join(F.broadcast(total))


QUERIES = {f.__name__: f for f in (
    l1_or_anchor, l1_module_anchor, l1_multiplicity, l1_and, event_build_merge, event_multiplicity, multiplicity_buckets, event_hits_flat,
    event_build_priority, event_with_ac, event_slices, l2_counter_flag_accept, l2_kept_events, l2_energy_gate, l2_min_hits, l2_ac_veto, built_event_arrays,
    module_correlation, anti_diagonal_pairs, first_hit_pairs, pair_fractions, pipeline_counters,
)}

ORD = ", ".join(ORDER)
EVENTS_SQL = f"""{HITS_SQL},
anchors AS (SELECT *, row_number() OVER (ORDER BY {ORD}) AS rn, lag(timestamp_ns) OVER (ORDER BY {ORD}) AS prev FROM hits WHERE channel = 0),
islands AS (SELECT *, sum(CASE WHEN prev IS NULL OR timestamp_ns - 60e9::DOUBLE > prev + 60e9::DOUBLE THEN 1 ELSE 0 END) OVER (ORDER BY rn) - 1 AS event_no FROM anchors),
built AS (SELECT CAST(event_no AS BIGINT) AS event_no, min(timestamp_ns) AS trigger_time, arg_min(module, rn) AS trigger_module, arg_min(channel, rn) AS trigger_channel,
          min(timestamp_ns) - 60e9::DOUBLE AS window_start, max(timestamp_ns) + 60e9::DOUBLE AS window_end, count(*) AS n_triggers FROM islands GROUP BY event_no),
members AS (SELECT b.*, h.event_id, h.module, h.channel, h.energy, h.energy_short, h.timestamp_ns, h.timestamp_ns - b.trigger_time AS relative_time
            FROM built b JOIN hits h ON h.timestamp_ns BETWEEN b.window_start AND b.window_end)"""
MERGE_SQL = f"""{EVENTS_SQL},
merged AS (SELECT event_no, trigger_time, trigger_module, trigger_channel, n_triggers, count(*) AS multiplicity, CAST(sum(energy) AS BIGINT) AS sum_energy,
           min(relative_time) AS first_ns, max(relative_time) AS last_ns FROM members GROUP BY ALL)"""
COUNTS_SQL = f"""{EVENTS_SQL},
counted AS (SELECT event_no, count(*) FILTER (WHERE channel IN (0, 1)) AS n_si, count(*) FILTER (WHERE channel = 2) AS n_ac, count(*) AS n FROM members GROUP BY event_no)"""


def _multiplicity_sql(where: str, need: int, window: str) -> str:
    return f"""WITH {HITS_SQL}, listed AS (SELECT * FROM hits WHERE {where})
        SELECT event_id, module, channel, timestamp_ns FROM listed h WHERE {need} <= (SELECT count(DISTINCT o.module * 256 + o.channel) FROM listed o
            WHERE o.timestamp_ns BETWEEN h.timestamp_ns - {window}::DOUBLE AND h.timestamp_ns)"""


FIRST_SQL = f"""{EVENTS_SQL},
firsts AS (SELECT * FROM members QUALIFY row_number() OVER (PARTITION BY event_no, module, channel ORDER BY relative_time, module, channel, energy, event_id) = 1)"""

ORACLE_SQL = {
    "l1_or_anchor": f"WITH {HITS_SQL} SELECT event_id, module, channel, timestamp_ns FROM hits WHERE channel = 0 AND module BETWEEN 0 AND 3",
    "l1_module_anchor": f"WITH {HITS_SQL} SELECT event_id, module, channel FROM hits WHERE module = 2 AND channel < 3",
    "l1_multiplicity": _multiplicity_sql("channel < 3", 3, "300e9"),
    "l1_and": _multiplicity_sql("(module = 1 AND channel = 0) OR (module = 2 AND channel = 1)", 2, "900e9"),
    "event_build_merge": f"WITH {MERGE_SQL} SELECT * FROM merged",
    "event_multiplicity": f"WITH {MERGE_SQL} SELECT multiplicity, count(*) AS events FROM merged GROUP BY 1",
    "multiplicity_buckets": f"""WITH {MERGE_SQL} SELECT CASE WHEN multiplicity <= 4 THEN CAST(multiplicity AS VARCHAR) WHEN multiplicity <= 8 THEN '5-8'
        WHEN multiplicity <= 16 THEN '9-16' WHEN multiplicity <= 32 THEN '17-32' ELSE '>=33' END AS bucket, count(*) AS events FROM merged GROUP BY 1""",
    "event_hits_flat": f"WITH {EVENTS_SQL} SELECT event_no, event_id, module, channel, energy, energy_short, relative_time FROM members",
    "event_build_priority": f"""WITH {HITS_SQL}, t AS (SELECT *, row_number() OVER (ORDER BY {ORD}) AS rn FROM hits WHERE channel = 0),
        kept AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.rn < t.rn AND o.timestamp_ns >= t.timestamp_ns - 300e9::DOUBLE AND o.module <= t.module)),
        numbered AS (SELECT *, row_number() OVER (ORDER BY rn) - 1 AS event_no FROM kept)
        SELECT n.event_no, n.timestamp_ns AS trigger_time, n.module AS trigger_module, h.event_id, h.timestamp_ns - n.timestamp_ns AS relative_time
        FROM numbered n JOIN hits h ON h.timestamp_ns BETWEEN n.timestamp_ns - 300e9::DOUBLE AND n.timestamp_ns + 300e9::DOUBLE""",
    "event_with_ac": f"""WITH {EVENTS_SQL}, marked AS (SELECT m.event_no, m.channel = 0 AND EXISTS (SELECT 1 FROM members o
            WHERE o.event_no = m.event_no AND o.module = m.module AND o.channel = 2) AS with_ac FROM members m)
        SELECT event_no, count(*) FILTER (WHERE with_ac) AS ac_hits, bool_or(with_ac) AS any_ac FROM marked GROUP BY event_no""",
    "event_slices": f"""WITH {HITS_SQL}, s AS (SELECT CAST(k AS BIGINT) AS slice_no, k * 82800e9::DOUBLE AS lo FROM range(40) r(k))
        SELECT slice_no, count(*) AS hits, count(*) FILTER (WHERE timestamp_ns < lo + 82800e9::DOUBLE) AS core_hits
        FROM s JOIN hits ON timestamp_ns >= lo AND timestamp_ns < lo + 86400e9::DOUBLE GROUP BY slice_no""",
    "l2_counter_flag_accept": f"""WITH {COUNTS_SQL}, f AS (SELECT *, n_si >= 2 AS two_si, n_ac = 0 AS no_ac FROM counted)
        SELECT event_no, n_si, n_ac, two_si, no_ac, true AS late, two_si AND no_ac AS both, two_si AS either, two_si AS keep,
               CASE WHEN two_si AND no_ac THEN 'both,either' WHEN two_si THEN 'either' ELSE '' END AS accepted FROM f""",
    "l2_kept_events": f"""WITH {COUNTS_SQL} SELECT row_number() OVER (ORDER BY b.trigger_time) - 1 AS event_no, b.trigger_time, b.trigger_module, c.n AS multiplicity, c.n_si, c.n_ac
        FROM counted c JOIN built b USING (event_no) WHERE c.n_si >= 2""",
    "l2_energy_gate": f"""WITH {EVENTS_SQL} SELECT event_no, count(*) AS multiplicity FROM members GROUP BY event_no
        HAVING bool_or(module = 1 AND channel = 0 AND energy BETWEEN 10000 AND 30000)""",
    "l2_min_hits": f"WITH {EVENTS_SQL} SELECT event_no, count(*) AS multiplicity FROM members GROUP BY event_no HAVING count(*) >= 2",
    "l2_ac_veto": f"""WITH {EVENTS_SQL}, v AS (SELECT DISTINCT a.event_no FROM members a JOIN members b ON a.event_no = b.event_no AND a.module = 1 AND a.channel = 0
            AND b.module = 2 AND b.channel = 1 AND abs(a.relative_time - b.relative_time) <= 50e9)
        SELECT event_no, event_no IN (SELECT event_no FROM v) AS veto, event_no IN (SELECT event_no FROM v) AS keep FROM built""",
    "built_event_arrays": f"""WITH {EVENTS_SQL}, r AS (SELECT *, NOT (module = trigger_module AND channel = trigger_channel AND relative_time = 0) AS later,
            channel = 0 AND EXISTS (SELECT 1 FROM members o WHERE o.event_no = m.event_no AND o.module = m.module AND o.channel = 2) AS with_ac FROM members m)
        SELECT event_no, trigger_time, trigger_module, trigger_channel, count(*) AS multiplicity,
            string_agg(CAST(module AS VARCHAR), ',' ORDER BY later, relative_time, module, channel, energy, energy_short, event_id) AS mod_list,
            string_agg(CAST(channel AS VARCHAR), ',' ORDER BY later, relative_time, module, channel, energy, energy_short, event_id) AS ch_list,
            string_agg(CAST(energy AS VARCHAR), ',' ORDER BY later, relative_time, module, channel, energy, energy_short, event_id) AS energy_list,
            string_agg(CAST(with_ac AS VARCHAR), ',' ORDER BY later, relative_time, module, channel, energy, energy_short, event_id) AS with_ac_list
        FROM r GROUP BY event_no, trigger_time, trigger_module, trigger_channel""",
    "module_correlation": f"""WITH {EVENTS_SQL}, e AS (SELECT event_no, trigger_module, {', '.join(f'bool_or(module = {m}) AS m{m}' for m in range(4))} FROM members GROUP BY ALL)
        SELECT trigger_module, count(*) AS events, {', '.join(f'round(avg(CAST(m{m} AS DOUBLE)), 9) AS with_m{m}' for m in range(4))} FROM e GROUP BY 1""",
    "anti_diagonal_pairs": f"""WITH {FIRST_SQL} SELECT a.event_no, a.channel AS ch_a, a.energy AS e_a, b.channel AS ch_b, b.energy AS e_b
        FROM firsts a JOIN firsts b ON a.event_no = b.event_no AND a.module = 0 AND b.module = 2 AND a.channel = 4 - b.channel""",
    "first_hit_pairs": f"""WITH {EVENTS_SQL}, f AS (SELECT * FROM members QUALIFY row_number() OVER (PARTITION BY event_no, module ORDER BY relative_time, module, channel, energy, event_id) = 1)
        SELECT a.event_no, a.channel AS ch_a, a.energy AS e_a, b.channel AS ch_b, b.energy AS e_b FROM f a JOIN f b ON a.event_no = b.event_no AND a.module = 0 AND b.module = 2""",
    "pair_fractions": f"""WITH {EVENTS_SQL}, e AS (SELECT event_no, bool_or(module = 0) AS a, bool_or(module = 2) AS b, count(*) AS n FROM members GROUP BY event_no)
        SELECT count(*) AS events, count(*) FILTER (WHERE a AND b) AS pairs, count(*) FILTER (WHERE n = 1) AS single,
               round(100.0::DOUBLE * count(*) FILTER (WHERE a AND b) / count(*), 9) AS pair_percent FROM e""",
    "pipeline_counters": f"""WITH {COUNTS_SQL} SELECT count(*) AS built, count(*) FILTER (WHERE n_si >= 2) AS kept, CAST(sum(n) AS BIGINT) AS member_hits,
        (SELECT count(*) FROM hits) AS hits FROM counted""",
}
