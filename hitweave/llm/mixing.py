"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Every source deals its documents, in an order fixed by the md5 of the id, into
blocks. With integer weights ``w`` of total ``W``, block ``k`` of a source is
released at slot ``floor(k*W/w)`` and due by slot ``ceil((k+1)*W/w)``;
earliest-deadline-first then fills one slot after another, so that every
source stays within one block of its target share at every slot. After ``W``
slots all sources are exactly on target and the schedule repeats, so one
period, worked out once from the weights alone, places any number of blocks by
division and remainder: the documents are ranked, joined to the period and never
gathered.

Every document is placed. When a source has run out its slots stay empty; the
bound holds against slots, for each source as long as it has documents.

Defined results: a null source is a source of its own, named ``''``; a source
without a weight has weight ``default_weight``; rows with equal ids stay in the
order of their length and text, then of all columns, maps by their sorted entries; what cannot be sorted by decides nothing; a null id sorts as the empty string; very long
texts are placed like others; other columns are kept, whatever their names, but for those that are added; an empty table
gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, packed, table

MAX_PERIOD = 1 << 16
HASH_RANGES = 1 << 16


def schedule(weights: dict[str, int]) -> Iterator[tuple[str, int]]:
    """``(source, block)`` for each slot of one period of ``sum(weights)`` slots, one after another."""
    total = sum(weights.values())
    waiting = [(0, name, 0) for name in sorted(weights)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    for now in range(total):
        while waiting and waiting[0][0] <= now:
            _, name, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // weights[name]), name, k))
        _, name, k = heapq.heappop(ready)
        yield name, k
        if k + 1 < weights[name]:
            heapq.heappush(waiting, ((k + 1) * total // weights[name], name, k + 1))


def period(weights: dict[str, int]) -> list[tuple[str, int]]:
    """The slots of one period as a list."""
    return list(schedule(weights))


def period_rows(shares: DataFrame) -> DataFrame:
    """``source, k, at, w`` for each slot of one period of ``shares``, rows of ``source, w``: streamed by one task, which holds a number a source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = {name: w for b in batches for name, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
        slots = enumerate(schedule(weights))
        while part := list(islice(slots, 1 << 16)):
            columns = [[n for _, (n, _) in part], [k for _, (_, k) in part], [at for at, _ in part], [weights[n] for _, (n, _) in part]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["source", "k", "at", "w"])

    return shares.select("source", "w").coalesce(1).mapInArrow(run, "source string, k long, at long, w long")


def ranked(docs: DataFrame, rows_per_range: int = 512) -> DataFrame:
    """``row``, all columns of ``docs``, with ``source`` and ``rank``, its place in its source by the md5 of its id.

    Ranges of the md5 are ranked apart and shifted by the counts before them,
    so that a source of any size is spread over many tasks.
    """
    last = "_tie" if "_tie" in docs.columns else "_row"
    ties = [F.col(f"row.{c}") for c in ("doc_id", "n_chars", "text", last) if c in docs.columns]
    rows = docs.select(packed(docs).alias("row"), F.coalesce("source", F.lit("")).alias("source"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("md5"))
    ranges = max(1, min(HASH_RANGES, docs.count() // rows_per_range))
    at = F.conv(F.substring("md5", 1, 4), 16, 10).cast("long")
    rows = rows.withColumn("range", F.floor(at * ranges / 65536).cast("int"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = rows.groupBy("source", "range").agg(F.count("*").alias("n"))
    shifts = shifts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("source", "range").orderBy("md5", *ties))
    placed = rows.withColumn("inside", inside - 1).join(shifts, ["source", "range"])
    return placed.select("row", "source", (F.col("inside") + F.col("shift")).alias("rank"))


#: Columns that :func:`mix` adds; columns of its input with such names are replaced.
ADDED = ("mix_source", "block_no", "release", "deadline", "slot", "place")


def mix(docs: DataFrame, weights: dict[str, int], default_weight: int = 1, block: int = 8, listed: int = 10_000, max_period: int = MAX_PERIOD) -> DataFrame:
    """``docs`` with its ``mix_source``, ``block_no``, ``release``, ``deadline``, ``slot`` and ``place`` (slot by slot, dense inside a block).

    Up to ``listed`` sources and ``max_period`` slots a period, after weights are divided by their greatest common divisor, the period is a small table that is broadcast; beyond,
    sources, weights and period are tables that are written and joined, with the same result.
    """
    sources = docs.select(F.coalesce("source", F.lit("")).alias("s")).distinct()
    names = [r["s"] for r in sources.limit(listed + 1).collect()]
    shares = {n: int(weights.get(n, default_weight)) for n in names}
    if any(w <= 0 for w in [default_weight, *weights.values()]):
        raise ValueError("weights must be positive")
    divisor = max(1, math.gcd(*shares.values()))
    shares = {n: w // divisor for n, w in shares.items()}
    total, plan = sum(shares.values()), None
    rows = ranked(docs).withColumn("block_no", F.expr(f"rank div {block}"))
    if len(names) <= listed and total <= max_period:
        plan = F.broadcast(docs.sparkSession.createDataFrame([(n, k, slot, shares[n]) for slot, (n, k) in enumerate(schedule(shares))], "source string, k long, at long, w long"))
        weight = F.create_map(*[F.lit(x) for name, w in shares.items() for x in (name, w)]) if shares else F.lit(None).cast("map<string,int>")
        rows = rows.withColumn("k", F.col("block_no") % F.element_at(weight, F.col("source")).cast("long"))
    else:
        given = docs.sparkSession.createDataFrame([(n, int(w)) for n, w in weights.items()] or [("", default_weight)], "s string, w long")
        table_of = durable(sources.join(given, "s", "left").select(F.col("s").alias("source"), F.coalesce("w", F.lit(default_weight).cast("long")).alias("w")))
        divisor = table_of.agg(F.aggregate(F.collect_set("w"), F.lit(0).cast("long"), _gcd)).first()[0]  # distinct weights only
        table_of = table_of.withColumn("w", F.expr(f"w div {divisor}"))
        total = table_of.agg(F.sum("w")).first()[0]
        plan = durable(period_rows(table_of))
        rows = rows.join(table_of, "source").withColumn("k", F.col("block_no") % F.col("w")).drop("w")
    placed = rows.join(plan, ["source", "k"])
    slot = F.expr(f"(block_no div w) * {total}L + at")
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ADDED]
    return placed.select(
        *kept, F.col("source").alias("mix_source"), "block_no", F.expr(f"block_no * {total}L div w").alias("release"),
        F.expr(f"((block_no + 1) * {total}L + w - 1) div w").alias("deadline"), slot.alias("slot"),
        (slot * block + F.expr(f"rank % {block}")).alias("place"),
    )


def _gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor, by as many steps of Euclid's as 64 bits can need."""
    pair = F.struct(a.alias("a"), b.alias("b"))
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), (p["a"] % F.when(p["b"] == 0, 1).otherwise(p["b"])).alias("b"))))
    return steps["a"]


#: Target weights of the registered query and the pipeline.
TARGETS = {f"src{i}": 1 + i % 4 for i in range(20)}


def sortable(kind: T.DataType) -> bool:
    """Whether Spark can sort by a type: by all but maps and variants, and what holds them."""
    if isinstance(kind, T.StructType):
        return all(sortable(f.dataType) for f in kind.fields)
    return sortable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def sort_key(field: T.StructField) -> Column | None:
    """A column of the struct ``_row`` to sort by, a map by its sorted entries; none where it can't be."""
    column, kind = F.col("_row").getField(field.name), field.dataType
    if isinstance(kind, T.MapType) and sortable(kind.keyType) and sortable(kind.valueType):
        return F.array_sort(F.map_entries(column)).alias(field.name)
    return column.alias(field.name) if sortable(kind) else None


def interleave(docs: DataFrame, weights: dict[str, int] | None = None, **settings) -> DataFrame:
    """All rows of ``docs``, columns unchanged, sorted by their place in the mix."""
    whole = docs.select("doc_id", "source", packed(docs).alias("_row"))
    if not all(sortable(f.dataType) for f in docs.schema.fields):
        whole = whole.withColumn("_tie", F.struct(*[c for f in docs.schema.fields if (c := sort_key(f)) is not None]))
    placed = mix(whole, TARGETS if weights is None else weights, **settings)
    return placed.orderBy("place").select("_row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the mix of its sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return mix(docs, TARGETS).select("doc_id", F.col("mix_source").alias("source"), "block_no", "release", "deadline", "slot", "place")


QUERIES = {"op6_mixing": op6_mixing}
ORACLE_SQL = {
    "op6_mixing": """
        WITH RECURSIVE docs AS (
            SELECT doc_id, coalesce(source, '') AS source, n_chars FROM documents),
        shares AS (
            SELECT source, CASE WHEN regexp_full_match(source, 'src1?[0-9]')
                                THEN 1 + CAST(substr(source, 4) AS BIGINT) % 4 ELSE 1 END AS w
            FROM (SELECT DISTINCT source FROM docs)),
        total AS (SELECT CAST(sum(w) AS BIGINT) AS t FROM shares),
        steps AS (
            SELECT CAST(0 AS BIGINT) AS now, source, w, CAST(0 AS BIGINT) AS k, false AS run FROM shares
            UNION ALL
            SELECT now + 1, source, w, k + CAST(chosen AS BIGINT), chosen FROM (
                SELECT now, source, w, k, k < w AND (k * t) // w <= now AND 1 = row_number() OVER (ORDER BY
                    CASE WHEN k < w AND (k * t) // w <= now THEN ((k + 1) * t + w - 1) // w ELSE 9223372036854775807 END, source) AS chosen
                FROM steps, total WHERE now < t)),
        period AS (SELECT source, k - 1 AS k, now - 1 AS slot FROM steps WHERE run),
        ranks AS (
            SELECT d.doc_id, d.source, s.w, t.t,
                   row_number() OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, n_chars) - 1 AS r
            FROM docs d JOIN shares s USING (source), total t),
        blocks AS (SELECT *, r // 8 AS block_no FROM ranks)
        SELECT b.doc_id, b.source, b.block_no, (b.block_no * b.t) // b.w AS release,
               ((b.block_no + 1) * b.t + b.w - 1) // b.w AS deadline,
               (b.block_no // b.w) * b.t + p.slot AS slot,
               ((b.block_no // b.w) * b.t + p.slot) * 8 + b.r % 8 AS place
        FROM blocks b JOIN period p ON p.source = b.source AND p.k = b.block_no % b.w"""
}
