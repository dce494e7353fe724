"""Histogram lists of two scopes, hits and coincidences, compiled to one pass over the rows of each scope."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.histograms import bin_of
from ..operators.ordered import bucket

#: Fixed values of the list format: variables and cuts of each scope. Coincidence variables are null where a hit has no such partner.
VARIABLES = {"hit": ("energy", "energy_short", "channel", "module", "psd"), "coincidence": ("dt1", "dt2", "gamma_energy", "thgem1_energy", "thgem2_energy")}
CUTS = {"hit": ("channel", "energy_range"), "coincidence": ("gamma_energy_range", "thgem1_energy_range", "thgem2_energy_range")}
SCOPE = {name: scope for table in (VARIABLES, CUTS) for scope, names in table.items() for name in names}
AXES = {"TH1D": ("x",), "TH2D": ("x", "y")}
SHORT = {"x": "fill", "xbins": "bins", "xmin": "min", "xmax": "max"}


@dataclass(frozen=True)
class Axis:
    variable: str
    low: float
    high: float
    bins: int


@dataclass(frozen=True)
class Spec:
    name: str
    scope: str
    axes: tuple[Axis, ...]
    cut: tuple[str, object] | None = None


def is_number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def axis(node: dict, letter: str, short: dict, wrong: list[str]) -> Axis | None:
    """One axis of a list entry; what is wrong with it is added to ``wrong``."""
    read = {part: node.get(letter + part, node.get(short.get(letter + part, ""))) for part in ("", "bins", "min", "max")}
    before = len(wrong)
    if read[""] is None:
        wrong.append(f"missing {letter}")
    elif not isinstance(read[""], str) or read[""] not in SCOPE or read[""] in CUTS["hit"] and read[""] not in VARIABLES["hit"] or read[""].endswith("_range"):
        wrong.append(f"unknown variable {read['']!r}")
    for part in ("bins", "min", "max"):
        if not is_number(read[part]):
            wrong.append(f"{letter}{part} is missing" if read[part] is None else f"{letter}{part} must be a number")
    if is_number(read["bins"]) and int(read["bins"]) <= 0:
        wrong.append(f"{letter}bins must be above 0")
    if is_number(read["min"]) and is_number(read["max"]) and read["min"] >= read["max"]:
        wrong.append(f"{letter}min must be below {letter}max")
    return Axis(read[""], float(read["min"]), float(read["max"]), int(read["bins"])) if len(wrong) == before else None


def cut_of(node: dict, wrong: list[str]) -> tuple[str, object] | None:
    found = [(name, node[name]) for names in CUTS.values() for name in names if name in node]
    for name, value in found:
        if name == "channel":
            if not is_number(value):
                wrong.append("cut channel must be a number")
        elif not isinstance(value, list) or len(value) != 2 or not all(map(is_number, value)):
            wrong.append(f"cut {name} must be two numbers")
        elif value[0] > value[1]:
            wrong.append(f"cut {name} is empty")
    if len(found) > 1:
        wrong.append("more than one cut")
    return found[0] if found else None


def compile_list(text: str) -> tuple[list[Spec], list[str]]:
    """The specs of a histogram list and all of its errors; with any error, no spec is to be used."""
    try:
        document = json.loads(text)
    except ValueError as error:
        return [], [f"malformed JSON: {error}"]
    nodes = document.get("histograms") if isinstance(document, dict) else None
    if not isinstance(nodes, list):
        return [], ["no list of histograms"]
    specs, errors, names = [], [], set()
    for place, node in enumerate(nodes):
        if not isinstance(node, dict):
            errors.append(f"histograms[{place}]: not an object")
            continue
        wrong: list[str] = []
        name = node.get("name")
        label = name if isinstance(name, str) and name else f"histograms[{place}]"
        if label != name:
            wrong.append("missing name")
        elif "/" in name:
            wrong.append("name has a slash")
        if name in names:
            wrong.append("doubled name")
        names.add(name if isinstance(name, str) else None)
        letters = AXES.get(node.get("type") if isinstance(node.get("type"), str) else None)
        if letters is None:
            errors += [f"{label}: {w}" for w in [*wrong, "unknown type"]]
            continue
        short = SHORT if letters == ("x",) else {}
        known = {"name", "title", "type", "drawopt", *short.values(), *(a + p for a in letters for p in ("", "bins", "min", "max")), *CUTS["hit"], *CUTS["coincidence"]}
        wrong += [f"unknown key {k}" for k in node if k not in known]
        wrong += [f"{k} must be text" for k in ("title", "drawopt") if not isinstance(node.get(k, ""), str)]
        axes, cut = [axis(node, a, short, wrong) for a in letters], cut_of(node, wrong)
        scopes = {SCOPE[a.variable] if a.variable in VARIABLES["hit"] + VARIABLES["coincidence"] else None for a in axes if a}
        if len(scopes | ({SCOPE[cut[0]]} if cut else set())) > 1:
            wrong.append("mixed scopes")
        errors += [f"{label}: {w}" for w in wrong]
        if not wrong:
            specs.append(Spec(name, scopes.pop(), tuple(axes), cut))
    return specs, errors


def passes(cut: tuple[str, object] | None) -> Column:
    if cut is None:
        return F.lit(True)
    name, value = cut
    return F.col("channel") == int(value) if name == "channel" else F.col(name.removesuffix("_range")).between(*value)


def slot(spec: Spec) -> Column:
    """The bin of a row, flat ``y * x_bins + x`` and -1 outside for two axes; null where the row is not counted."""
    values = [F.col(a.variable).cast("double") for a in spec.axes]
    bins = [bin_of(v, a.low, a.high, a.bins) for v, a in zip(values, spec.axes)]
    at = bins[0]
    if len(bins) == 2:
        inside = [(b >= 0) & (b < a.bins) for b, a in zip(bins, spec.axes)]
        at = F.when(inside[0] & inside[1], bins[1] * spec.axes[0].bins + bins[0]).otherwise(-1)
    met = passes(spec.cut)
    for v in values:
        met = met & v.isNotNull()
    return F.when(met, at)


def fill_scope(rows: DataFrame, specs: list[Spec], keys: list[str] | None = None) -> DataFrame:
    """``name, bin, counts`` of all specs of one scope, after ``keys`` if given, in one pass: a row is dealt to every histogram that takes it."""
    dealt = F.array(*[F.struct(F.lit(s.name).alias("name"), slot(s).cast("int").alias("bin")) for s in specs])
    taken = rows.select(*(keys or []), F.explode(F.filter(dealt, lambda h: h["bin"].isNotNull())).alias("h"))
    return taken.groupBy(*(keys or []), "h.name", "h.bin").agg(F.count("*").alias("counts"))


def coincidences(hits: DataFrame, gamma: int, partners: tuple[int, int], window_ns: float) -> DataFrame:
    """One row a hit of channel ``gamma`` with the variables of the coincidence scope: the nearest hit of each partner channel within the window, modules disregarded.

    One scan: partners are copied to the neighbouring time buckets, and in each bucket one pass forwards and one back find the last partner before and the first after.
    Of two equally near the earlier counts, of several at one time the least ``event_id``.
    """
    channel, time = F.col("channel"), F.col("timestamp_ns")
    kind = F.when(channel == gamma, 0).when(channel == partners[0], 1).when(channel == partners[1], 2)
    own = bucket("timestamp_ns", window_ns)
    rows = hits.select("event_id", "energy", "timestamp_ns", kind.alias("kind")).filter("kind IS NOT NULL AND timestamp_ns IS NOT NULL")
    spread = rows.withColumn("_b", F.explode(F.when(F.col("kind") == 0, F.array(own)).otherwise(F.sequence(own - 1, own + 1))))
    partner_first = F.when(F.col("kind") == 0, 1).otherwise(0)
    upto = (Window.unboundedPreceding, 0)
    passes_of = {"before": Window.partitionBy("_b").orderBy("timestamp_ns", partner_first, F.desc("event_id")).rowsBetween(*upto),
                 "after": Window.partitionBy("_b").orderBy(F.desc("timestamp_ns"), partner_first, F.desc("event_id")).rowsBetween(*upto)}
    found = spread
    for side, w in passes_of.items():
        for k in (1, 2):
            found = found.withColumn(f"{side}{k}", F.last(F.when(F.col("kind") == k, F.struct(time.alias("t"), "energy")), ignorenulls=True).over(w))
    found = found.filter("kind = 0")
    out = [F.col("event_id"), F.col("energy").alias("gamma_energy")]
    for k in (1, 2):
        back, on = time - F.col(f"before{k}.t"), F.col(f"after{k}.t") - time
        near_back = F.coalesce(back <= window_ns, F.lit(False))
        near_on = F.coalesce(on <= window_ns, F.lit(False))
        pick = F.when(near_back & (~near_on | (back <= on)), F.col(f"before{k}")).when(near_on, F.col(f"after{k}"))
        out += [(pick["t"] - time).alias(f"dt{k}"), pick["energy"].alias(f"thgem{k}_energy")]
    return found.select(*out)


def fill(hits: DataFrame, specs: list[Spec], gamma: int, partners: tuple[int, int], window_ns: float) -> DataFrame:
    """``name, bin, counts`` of all specs; a histogram without entries has no row. The hits are scanned once a scope."""
    of = {scope: [s for s in specs if s.scope == scope] for scope in VARIABLES}
    made = []
    if of["hit"]:
        psd = F.when(F.col("energy") > 0, (F.col("energy") - F.col("energy_short")).cast("float") / F.col("energy").cast("float"))
        made.append(fill_scope(hits.withColumn("psd", psd), of["hit"]))
    if of["coincidence"]:
        made.append(fill_scope(coincidences(hits, gamma, partners, window_ns), of["coincidence"]))
    if not made:
        raise ValueError("no histograms")
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])
