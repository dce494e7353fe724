"""Exact de-duplication that no hot content can slow down, in DataFrame operations only.

Three combining steps, each of which groups by the digest *and* the whole
normalised text, so equality is always decided on the content:

1. every map task combines its own equal texts (Spark's partial aggregation,
   helped by a salt that is constant within a task);
2. the salted groups ``(digest, text, salt)`` meet and combine;
3. the at most ``salts`` winners of a content combine globally.

Then each row looks its group up by digest, so that only ids and digests move
again. Should two contents ever share a SHA-256 digest, the job stops instead
of merging them; ``exact_dedup_by_content`` looks rows up by their whole text.

Defined results: a null text counts as empty; a null doc_id ranks behind
every other and is kept only in a group with no other id, where ``keep_id`` is null; rows
repeated with the same id all count in ``group_size`` and are all marked kept
if that id is the smallest. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, lookup, packed, table

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")


def content_groups(rows: DataFrame, salts: int = 16) -> DataFrame:
    """One row per distinct ``_norm`` with ``_digest, keep_id, group_size``; ``rows`` has ``_id, _digest, _norm``."""
    local = rows.withColumn("_salt", F.spark_partition_id() % salts)
    salted = local.groupBy("_digest", "_norm", "_salt").agg(F.min("_id").alias("_id"), F.count("*").alias("_n"))
    return salted.groupBy("_digest", "_norm").agg(F.min("_id").alias("keep_id"), F.sum("_n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """Per row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = docs.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_norm"))
    rows = rows.withColumn("_digest", F.sha2("_norm", 256))
    groups = content_groups(rows, salts)
    by_digest = groups.groupBy("_digest").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("_contents")
    )
    clash = F.raise_error(F.lit("two contents share a SHA-256 digest; use exact_dedup_by_content"))
    by_digest = by_digest.withColumn("group_size", F.when(F.col("_contents") > 1, clash.cast("long")).otherwise(F.col("group_size")))
    by_digest = durable(by_digest.drop("_contents"))
    return _verdict(lookup(rows.select("_id", "_digest"), by_digest, "_digest", "group_size", docs.count()))


def exact_dedup_by_content(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The same result with every row looked up by its whole text, for digests that collide."""
    rows = docs.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_norm"))
    rows = rows.withColumn("_digest", F.sha2("_norm", 256))
    return _verdict(rows.join(content_groups(rows, salts), ["_digest", "_norm"]))


def _verdict(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("_id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged; of rows with equal id and text one stays."""
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").alias("_id"), normalised("text").alias("_norm"))
    rows = rows.withColumn("_digest", F.sha2("_norm", 256))
    groups = content_groups(rows.select("_id", "_digest", "_norm"), salts)
    winners = groups.select(F.col("_digest").alias("_of"), F.col("keep_id").alias("_keep"))
    kept = rows.drop("_norm").join(winners, (F.col("_digest") == F.col("_of")) & F.col("_id").eqNullSafe(F.col("_keep")), "left_semi")
    again = docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_again"))
    if again.isEmpty():
        return kept.select("row.*")
    same = F.col("_id").eqNullSafe(F.col("_again"))
    sure, unsure = kept.join(again, same, "left_anti"), kept.join(again, same, "left_semi")
    return sure.unionByName(unsure.dropDuplicates(["_id", "_digest"])).select("row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of all documents by their white-space-folded text."""
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLE_SQL = {
    "op5_exact_dedup": r"""
        WITH rows AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
        FROM rows WINDOW g AS (PARTITION BY text_sha256)"""
}
