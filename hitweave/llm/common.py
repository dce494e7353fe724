"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``; see :func:`shared_folder`.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session that is one process (``local[...]``) may lack the setting; it gets a temporary folder. A cluster has to name one.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="hitweave-")


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def below_fraction(col: Column, fraction: Column) -> Column:
    """True for that fraction of the values, chosen by a hash of the value."""
    return (F.pmod(F.xxhash64(col), F.lit(1 << 30)) / F.lit(float(1 << 30))) < fraction


def class_sample(df: DataFrame, label: str, per_class: int, max_rows: int = 1 << 16) -> DataFrame:
    """About ``per_class`` rows of each label, at most twice as many; ``max_rows`` (and as many again) bounds all labels together.

    Chosen by a hash of ``doc_id``, so that the same rows come out on every
    run; the counts behind the fractions cover all rows. With more than ``max_rows / per_class`` labels each gets
    fewer rows, with more than ``max_rows`` the commonest get one.
    """
    counts = df.groupBy(label).count().orderBy(F.desc("count"), F.asc(label)).limit(max_rows).collect()
    if not counts:
        return df.limit(0)
    each = min(per_class, max(1, max_rows // len(counts)))
    kind = df.select(label).schema[0].dataType.simpleString()
    shares = df.sparkSession.createDataFrame([(row[label], min(1.0, each / row["count"])) for row in counts], f"_of {kind}, _share double")
    met = df.join(F.broadcast(shares), F.col(label) == F.col("_of"))  # at most max_rows rows
    return met.filter(below_fraction(F.col("doc_id"), F.col("_share"))).select(df.columns).limit(2 * each * len(counts))


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, max_chars: int
) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled texts for the driver, in a fixed order.

    Labels come only from rows where ``train`` holds; a document labelled twice
    takes its largest label, a repeated id its least text. Texts above ``max_chars`` stay out of the sample.
    """
    known = labels.filter(train & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    picked = class_sample(known, "label", per_class)
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.char_length("text") <= max_chars))
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [r["label"] for r in rows]


def with_score(docs: DataFrame, score: Column, keep: list[str], threshold: float) -> DataFrame:
    """The ``keep`` columns of ``docs``, unchanged, then ``score`` and ``predicted``; columns so named are not kept."""
    kept = [c for c in keep if c not in ("score", "predicted")]
    made = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), score.alias("score"))
    return made.select(*[F.col(f"row.`{c}`") for c in kept], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def lookup(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, parts: int = 1000) -> DataFrame:
    """Join every row to its key's only row in ``groups``, which has the key's row count in ``size``.

    Keys with over ``total / parts`` rows, of which there are fewer than
    ``parts``, are broadcast; the rows of such keys go round the shuffle join by
    keys of their own, so that no task gets more than its share. ``groups``
    is read twice and should be durable; ``key`` is not null.
    """
    names = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) * parts > total).select(F.col(key).alias("_hot"), F.struct(*names).alias("_found"))
    rest = groups.filter(F.col(size) * parts <= total).select(F.col(key).cast("string").alias("_cold"), F.struct(*names).alias("_other"))
    seen = rows.join(F.broadcast(hot), rows[key] == hot["_hot"], "left")
    spread = F.concat(F.lit("#"), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)).cast("string"))
    seen = seen.withColumn("_cold", F.when(F.col("_hot").isNull(), F.col(key).cast("string")).otherwise(spread))
    both = seen.join(rest, "_cold", "left").withColumn("_found", F.coalesce("_found", "_other"))
    return both.select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in names])


def bit_table(hashes: DataFrame, name: str, count: int, most: int = 1 << 26) -> tuple[DataFrame, int]:
    """A bit set of the 64-bit hashes in column ``name``, as rows ``_word, _mask``, and its size in bits.

    At most ``most`` bits, so at most ``most / 64`` rows: small enough to broadcast at any input size.
    """
    bits = 1 << 12
    while bits < min(most, 16 * count):
        bits *= 2
    at = F.pmod(F.col(name), F.lit(bits))
    rows = hashes.select(F.floor(at / 64).cast("long").alias("_word"), F.expr(f"shiftleft(1L, int(pmod(`{name}`, 64)))").alias("_bit"))
    return rows.groupBy("_word").agg(F.bit_or("_bit").alias("_mask")), bits


def maybe_in(rows: DataFrame, name: str, bits_of: DataFrame, bits: int) -> DataFrame:
    """Rows whose hash ``name`` may be in the bit set: all that are, and a few more that the caller sorts out."""
    here = rows.withColumn("_word", F.floor(F.pmod(F.col(name), F.lit(bits)) / 64).cast("long"))
    met = here.join(F.broadcast(bits_of), "_word")
    return met.filter(F.expr(f"(shiftright(_mask, int(pmod(`{name}`, 64))) & 1L) = 1L")).drop("_word", "_mask")
