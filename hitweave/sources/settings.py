"""Settings documents: event-build graphs, channel tables, clock offsets and histogram lists.

Documents are small and parsed on the driver; what they describe is lowered to
columns and literal tables.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import Filter, Trigger, validate, validate_filters
from ..operators.histograms import hist1d, hist2d


@dataclass(frozen=True)
class BuildSettings:
    window_ns: float
    triggers: list[Trigger]
    root: str
    filters: list[Filter]


def _trigger(node: dict, default_ns: float) -> Trigger:
    return Trigger(
        node["name"], node["type"], node.get("module"), node.get("channel"), node.get("channels"), tuple(node.get("inputs", ())),
        node.get("min", 0), float(node.get("window_ns") or default_ns),
    )


def _filter(node: dict) -> Filter:
    """A filter of either spelling: lower-case keys, or the older capitalised ones."""
    node = {k.lower(): v for k, v in node.items()}
    monitor = node.get("monitor", ())
    return Filter(
        node["name"], node["type"].lower(), tuple(node.get("tags", ())), (monitor,) if isinstance(monitor, str) else tuple(monitor),
        op=node.get("operator", ">="), value=int(node.get("value", node.get("min", 0))), logic=node.get("operator", "AND"),
        module=node.get("module", node.get("trigger_module", 0)), channel=node.get("channel", node.get("trigger_channel", 0)),
        low=int(node.get("min", 0)), high=int(node.get("max", 65535)), veto_module=node.get("veto_module", 0),
        veto_channel=node.get("veto_channel", 0), window_ns=float(node.get("window_ns", 0.0)),
    )


def build_settings(text: str) -> BuildSettings:
    """Checked settings of an event-build document."""
    doc = json.loads(text)
    timing = doc["timing"]
    window = float(timing["coincidence_window_ns"])
    if float(timing.get("slice_duration_ns", window * 2)) <= window:
        raise ValueError("a slice must be longer than the window")
    triggers = [_trigger(n, window) for n in doc["l1"]["definitions"]]
    validate(triggers, doc["l1"]["trigger"], window)
    filters = [_filter(n) for n in doc.get("l2", ())]
    if filters:
        validate_filters(filters)
    return BuildSettings(window, triggers, doc["l1"]["trigger"], filters)


def command_line_triggers(arguments: list[str]) -> list[Trigger]:
    """Triggers written ``module:channel``, under the root ``any``; earlier ones have priority."""
    leaves = [Trigger(a, "channel", module=int(a.split(":")[0]), channel=int(a.split(":")[1])) for a in arguments]
    return [*leaves, Trigger("any", "or", inputs=tuple(arguments))]


def channel_table(spark: SparkSession, text: str) -> DataFrame:
    """``module, channel, detector_type, tags, p0..p3`` of a list of lists of channels; unknown keys are ignored."""
    rows = [
        (c["Module"], c["Channel"], c.get("DetectorType", ""), c.get("Tags", []), *[float(c.get(f"p{i}", i == 1)) for i in range(4)])
        for module in json.loads(text) for c in module
    ]
    return spark.createDataFrame(rows, "module int, channel int, detector_type string, tags array<string>, p0 double, p1 double, p2 double, p3 double")


def channel_tags(text: str) -> dict[tuple[int, int], set[str]]:
    return {(c["Module"], c["Channel"]): set(c.get("Tags", ())) for module in json.loads(text) for c in module}


def clock_offsets(text: str) -> list[tuple]:
    """Offset entries of a tree document, or of the older flat one, whose malformed keys are warned of and left out."""
    doc = json.loads(text)
    if "entries" in doc:
        return [(e["module"], e["channel"], *(e["ref"] or (None, None)), float(e["offset_ns"])) for e in doc["entries"]]
    root = (doc["ref_module"], doc["ref_channel"])
    found = {root: (*root, None, None, 0.0)}
    for key, value in doc["offsets"].items():
        parts = key.split("_")
        if len(parts) != 2 or not all(p.isdigit() for p in parts):
            warnings.warn(f"offset key {key!r} is not <module>_<channel>", stacklevel=2)
            continue
        at = (int(parts[0]), int(parts[1]))
        found[at] = (*at, *((None, None) if at == root else root), float(value))
    return list(found.values())


def flat_offsets(offsets: dict[tuple[int, int], float], root: tuple[int, int]) -> str:
    """The older flat document, with zero-padded keys in order."""
    keys = {f"{m:02d}_{c:02d}": v for (m, c), v in sorted(offsets.items())}
    return json.dumps({"ref_module": root[0], "ref_channel": root[1], "offsets": keys})


HIT_AXES = ("energy", "energy_short", "channel", "module")
CUTS = ("channel", "energy_range")


@dataclass(frozen=True)
class HistogramSpec:
    name: str
    axes: tuple[tuple[str, float, float, int], ...]
    cut: tuple[str, object] | None = None


def histogram_specs(text: str, axes: tuple[str, ...] = HIT_AXES, cuts: tuple[str, ...] = CUTS) -> tuple[list[HistogramSpec], list[str]]:
    """Specs of a histogram list and all its errors; use none of the specs if there is any error."""
    specs: list[HistogramSpec] = []
    errors: list[str] = []
    for number, node in enumerate(json.loads(text)["histograms"]):
        label, before = node.get("name") or f"histograms[{number}]", len(errors)
        if not node.get("name") or "/" in node["name"] or any(s.name == node["name"] for s in specs):
            errors.append(f"{label}: the name is missing, doubled or has a slash")
        letters = {"TH1D": "x", "TH2D": "xy"}.get(node.get("type"))
        if letters is None:
            errors.append(f"{label}: unknown type")
            continue
        short = {"x": "fill", "xbins": "bins", "xmin": "min", "xmax": "max"} if letters == "x" else {}
        known = {"name", "type", "title", "drawopt", *cuts, *short.values()} | {a + part for a in letters for part in ("", "bins", "min", "max")}
        errors += [f"{label}: unknown key {k!r}" for k in node if k not in known]
        found = []
        for a in letters:
            variable, bins, low, high = (node.get(a + part, node.get(short.get(a + part, ""))) for part in ("", "bins", "min", "max"))
            if variable not in axes:
                errors.append(f"{label}: unknown variable {variable!r}")
            elif not isinstance(bins, int) or bins <= 0 or not isinstance(low, (int, float)) or not isinstance(high, (int, float)) or low >= high:
                errors.append(f"{label}: bad {a} axis")
            else:
                found.append((variable, float(low), float(high), bins))
        chosen = [(c, node[c]) for c in cuts if c in node]
        if len(chosen) > 1:
            errors.append(f"{label}: more than one cut")
        if len(errors) == before:
            specs.append(HistogramSpec(node["name"], tuple(found), chosen[0] if chosen else None))
    return specs, errors


def cut_column(cut: tuple[str, object] | None) -> Column:
    if cut is None:
        return F.lit(True)
    name, value = cut
    return F.col(name) == value if not name.endswith("_range") else F.col(name.removesuffix("_range")).between(*value)


def fill(rows: DataFrame, specs: list[HistogramSpec]) -> DataFrame:
    """``name, bin, counts`` of all histograms."""
    parts = []
    for spec in specs:
        kept = rows.filter(cut_column(spec.cut))
        if len(spec.axes) == 1:
            variable, low, high, bins = spec.axes[0]
            made = hist1d(kept, [], F.col(variable), low, high, bins)
        else:
            (x, *xs), (y, *ys) = spec.axes
            made = hist2d(kept, [], F.col(x), F.col(y), tuple(xs), tuple(ys))
        parts.append(made.select(F.lit(spec.name).alias("name"), "bin", "counts"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
