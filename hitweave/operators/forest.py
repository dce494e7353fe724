"""Chains of references resolved by pointer doubling: each round every entry looks twice as far up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable


def resolve(entries: DataFrame, node: str, parent: str, offset: str) -> DataFrame:
    """``node, root, offset, depth, fault`` of every listed node, once: offsets summed from the node to its root, which counts itself, and the steps between.

    ``fault`` is null where a root was reached; else root, offset and depth are null and it is ``double`` (listed more than once), ``dangling`` (its parent is not listed), ``cycle`` (it
    leads into one) or ``above`` (an entry above is one of the first two). A null parent marks a root; entries without a node are passed over. Any number of entries, chains of any
    length: a chain of n takes some log2(n) rounds, each a join that is written out.
    """
    listed = entries.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("_node")).agg(
        F.count("*").alias("_times"), F.first(parent).alias("_up"), F.first(F.col(offset).cast("double")).alias("_sum"))
    known = listed.select(F.col("_node").alias("_known"))
    met = listed.join(known, listed["_up"] == known["_known"], "left")
    fault = F.when(F.col("_times") > 1, "double").when(F.col("_up").isNotNull() & F.col("_known").isNull(), "dangling")
    ways = met.select("_node", fault.alias("_fault"), "_up", "_sum").select(
        "_node", F.when(F.col("_fault").isNull(), F.col("_up")).alias("_up"), "_sum", F.when(F.col("_up").isNotNull() & F.col("_fault").isNull(), 1).otherwise(0).cast("long").alias("_steps"),
        F.when(F.col("_up").isNull(), F.col("_node")).alias("_root"), "_fault",
    )
    ways = durable(ways)
    far, count = 1, ways.count()
    while far <= count and not ways.filter("_up IS NOT NULL").isEmpty():  # beyond that only cycles go on
        above = ways.select(F.col("_node").alias("_up"), *[F.col(c).alias(f"{c}2") for c in ("_up", "_sum", "_steps", "_root", "_fault")])
        joined = ways.join(above, "_up", "left")
        on = F.col("_up").isNotNull()
        ways = durable(joined.select(
            "_node", F.col("_up2").alias("_up"), F.when(on, F.col("_sum") + F.col("_sum2")).otherwise(F.col("_sum")).alias("_sum"),
            F.when(on, F.col("_steps") + F.col("_steps2")).otherwise(F.col("_steps")).alias("_steps"), F.when(on, F.col("_root2")).otherwise(F.col("_root")).alias("_root"),
            F.when(on & F.col("_fault2").isNotNull(), "above").otherwise(F.col("_fault")).alias("_fault"),
        ))
        far *= 2
    fault = F.when(F.col("_up").isNotNull(), "cycle").otherwise(F.col("_fault"))
    good = fault.isNull()
    return ways.select(
        F.col("_node").alias("node"), F.when(good, F.col("_root")).alias("root"), F.when(good, F.col("_sum")).alias("offset"),
        F.when(good, F.col("_steps")).alias("depth"), fault.alias("fault"),
    )


def warnings(resolved: DataFrame, deep: int = 5) -> DataFrame:
    """``warning, count``: several roots, and entries more than ``deep`` steps from theirs."""
    seen = resolved.filter("fault IS NULL").agg(F.count_if(F.col("depth") == 0).alias("roots"), F.count_if(F.col("depth") > deep).alias("deep"))
    rows = seen.select(F.explode(F.array(*[F.struct(F.lit(w).alias("warning"), c.alias("count")) for w, c in (("several roots", F.when(F.col("roots") > 1, F.col("roots"))), ("deep", F.when(F.col("deep") > 0, F.col("deep"))))])).alias("w"))
    return rows.select("w.*").filter("count IS NOT NULL")


def against_one(resolved: DataFrame) -> DataFrame:
    """``node, ref, offset``: all offsets under the smallest root as the only reference."""
    good = resolved.filter("fault IS NULL")
    one = good.agg(F.min("root").alias("ref"))  # a single row
    return good.join(F.broadcast(one)).select("node", "ref", "offset")
