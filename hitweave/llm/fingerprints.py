"""Canonical exact fingerprints of documents, in DataFrame operations only.

A text is made canonical by Unicode normalisation (NFKC), full case folding and
folding white space (normalisation and case folding are those of ICU, whose jar comes with Spark); two chained 64-bit xxhash values make a 128-bit digest. Rows
are grouped by digest, and inside each digest shared by several rows the
canonical bytes are compared: if they differ, the distinct contents are
numbered in byte order and the number becomes part of the fingerprint.

Defined results: a null text counts as empty; very long texts are digested whole; rows with equal ids stay apart
and follow each other by a hash of their text; a null id comes last; one document alone is its
own next document; an empty table gives no rows. :func:`fingerprint_documents` keeps all columns but one with the
name of the fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bit_table, durable, maybe_in, packed, table

WHITE = r"[\p{Z}\x09-\x0D\x{85}]+"
SALTS = 64
MAX_RANGES = 1 << 15


def canonical(text: Column) -> Column:
    """NFKC, folded case, single spaces, no outer spaces."""

    def composed(x: Column) -> Column:
        return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(text), F.lit(True))
    return F.trim(F.regexp_replace(composed(folded), WHITE, " "))


def with_digest(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the struct ``name``: two xxhash halves and, to tell clashing contents apart, a SHA-256."""
    rows = rows.withColumn("_c", canonical(F.coalesce(F.col(text), F.lit(""))))
    seeded = F.xxhash64(F.lit("second half"), F.octet_length("_c"), F.col("_c"))
    made = F.struct(F.xxhash64("_c").alias("d1"), seeded.alias("d2"), F.unhex(F.sha2("_c", 256)).alias("sha"))
    return rows.withColumn(name, made).drop("_c")


def shared_digests(digests: DataFrame) -> DataFrame:
    """``d1, d2`` of the digests ``d`` that several rows have."""
    return digests.groupBy("d.d1", "d.d2").count().filter("count > 1").select("d1", "d2")


def candidates(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows of ``d, text`` whose digest may be shared: a bounded bit set keeps the other texts from moving."""
    bits_of, bits = bit_table(shared, "d1", shared.count())
    return maybe_in(texts.withColumn("_h", F.col("d.d1")), "_h", bits_of, bits).drop("_h")


def clashes(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """``d1, d2, sha, number`` of the contents of every digest of ``shared`` that has several; ``texts`` has ``d, text``.

    The canonical bytes of the rows of a digest are compared. A digest of very
    many rows is spread over salts, each of which keeps its least and greatest content.
    """
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = texts.select("d.*", "text").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    members = spread.join(salted, ["d1", "d2", "salt"], "left_semi").withColumn("canon", canonical(F.col("text")))
    ends = members.groupBy("d1", "d2", "salt").agg(F.min("canon").alias("a"), F.max("canon").alias("b"))
    differ = ends.groupBy("d1", "d2").agg(F.min("a").alias("a"), F.max("b").alias("b")).filter("a != b").select("d1", "d2")
    differ = durable(differ)
    if differ.isEmpty():
        return differ.select("d1", "d2", F.lit(b"").alias("sha"), F.lit(0).alias("number"))
    apart = members.join(differ, ["d1", "d2"], "left_semi").select("d1", "d2", "sha", "canon").distinct()
    number = F.row_number().over(Window.partitionBy("d1", "d2").orderBy("canon")) - 1
    return apart.select("d1", "d2", "sha", number.alias("number"))


def fingerprint_text(digest: str, number: Column) -> Column:
    halves = [F.lpad(F.lower(F.hex(f"{digest}.{half}")), 16, "0") for half in ("d1", "d2")]
    return F.concat(*halves, F.when(number > 0, F.concat(F.lit("-"), number.cast("string"))).otherwise(F.lit("")))


def name_contents(rows: DataFrame, numbered: DataFrame, digest: str, name: str) -> DataFrame:
    """Adds the fingerprint ``name`` of the digest struct ``digest``."""
    found = numbered.select(F.struct("d1", "d2", "sha").alias("_of"), "number")
    joined = rows.join(found, rows[digest] == found["_of"], "left")
    return joined.withColumn(name, fingerprint_text(digest, F.coalesce("number", F.lit(0)))).drop("_of", "number")


def fingerprint_documents(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """All columns of ``docs`` and its fingerprint: equal exactly for texts of equal canonical form."""
    rows = with_digest(docs.select(packed(docs).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", "d")
    shared = durable(shared_digests(rows))
    found = name_contents(rows, clashes(candidates(rows.select("d", "text"), shared), shared), "d", "_made")
    return found.select(*[F.col(f"row.`{c}`") for c in docs.columns if c != name], F.col("_made").alias(name))


def id_ranges(rows: DataFrame, id_col: str, tie: str, rows_per_range: int) -> DataFrame:
    """Adds ``_range``, which rises with falling ``id_col``, nulls last, and then with the long ``tie``; about ``rows_per_range`` rows each.

    Ranges are of equal width in the id first. Any that is too full, because ids are uneven, repeated or null, is cut again between
    its own least and greatest id, and inside one id by the tie.
    """
    low, high, count = rows.agg(F.min(id_col), F.max(id_col), F.count("*")).first()
    low, high, size = low or 0, high or 0, max(rows_per_range, -(-count // MAX_RANGES))
    ranges = max(1, -(-count // size))
    width = -(-(high - low + 1) // ranges)
    rows = rows.withColumn("_range", F.coalesce(F.expr(f"({high}L - `{id_col}`) div {width}L"), F.lit(ranges + 1)).cast("long"))
    for _ in range(3):
        heads = rows.groupBy("_range").agg(F.min(id_col).alias("_low"), F.max(id_col).alias("_high"), F.count("*").alias("_n"))
        if ranges == 1 or (heads.agg(F.max("_n")).first()[0] or 0) <= 4 * size:
            break
        heads = heads.withColumn("_pieces", F.ceil(F.col("_n") / size)).drop("_n")  # at most twice MAX_RANGES rows
        before = F.coalesce(F.sum("_pieces").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        met = rows.join(F.broadcast(heads.withColumn("_before", before)), "_range")
        inside = F.coalesce(F.col("_high") - F.col(id_col), F.lit(0)) + F.shiftrightunsigned(tie, 11).bitwiseXOR(F.lit(1 << 52)) / F.lit(float(1 << 53))
        piece = F.floor(inside / F.coalesce(F.col("_high") - F.col("_low") + 1, F.lit(1)) * F.col("_pieces"))
        rows = met.withColumn("_range", F.col("_before") + F.least(piece, F.col("_pieces") - 1)).drop("_low", "_high", "_pieces", "_before")
    return rows


def with_next(rows: DataFrame, id_col: str, text_col: str, rows_per_range: int = 512) -> DataFrame:
    """Each row with ``_next``: a struct of the row with the next smaller id, or of the largest id after the last.

    Ranges of ids are ordered apart from each
    other; the last row of a range takes the first row of the next filled
    range. The table of first rows is bounded by twice ``MAX_RANGES``.
    """
    names = rows.columns
    rows = id_ranges(rows.withColumn("_tie", F.xxhash64(text_col)), id_col, "_tie", rows_per_range)
    order = Window.partitionBy("_range").orderBy(F.desc_nulls_last(id_col), "_tie", text_col)
    inside = rows.withColumns({f"_after_{c}": F.lead(c).over(order) for c in names} | {"_more": F.lead(F.lit(True)).over(order)})
    tops = rows.groupBy("_range").agg(F.max(id_col).alias("_top")).withColumnRenamed("_range", "_head_of")
    at_top = (F.col("_range") == F.col("_head_of")) & F.col(id_col).eqNullSafe(F.col("_top"))
    heads = rows.join(F.broadcast(tops), at_top).groupBy("_head_of").agg(F.min_by(F.struct(*names), F.struct("_tie", text_col)).alias("_head"))
    every = Window.orderBy("_head_of")
    wrap = F.min("_head_of").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follow = tops.select(F.col("_head_of").alias("_range"), F.coalesce(F.lead("_head_of").over(every), wrap).alias("_head_of"))
    firsts = follow.join(heads, "_head_of").select("_range", "_head")
    joined = inside.join(firsts, "_range")
    follower = F.when(F.col("_more"), F.struct(*[F.col(f"_after_{c}").alias(c) for c in names])).otherwise(F.col("_head"))
    return joined.select(*names, follower.alias("_next"))


def likeness(one: str, other: str) -> Column:
    """1 for the same canonical content, else 0."""
    return F.when(F.col(one) == F.col(other), F.lit(1.0)).otherwise(F.lit(0.0))


def edited_text(text: str, other: str) -> Column:
    """``text`` with its last ``floor(n / 2)`` code points replaced by the first as many of ``other``."""
    n = f"char_length({text})"
    return F.expr(f"concat(left({text}, int({n} - {n} div 2)), left({other}, int({n} div 2)))")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their texts edited with the next document's start."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_digest(docs.withColumn("h", F.xxhash64("text")), "text", "d")
    paired = with_next(rows, "doc_id", "text").withColumn("edited", edited_text("text", "_next.text"))
    marked = durable(with_digest(paired, "edited", "e").select(
        "doc_id", "h", F.struct("_next.doc_id", "_next.h").alias("next"), F.char_length("text").cast("long").alias("n_chars"),
        F.unhex(F.sha2("edited", 256)).alias("sha"), "d", "e", likeness("d", "_next.d").alias("near_next"),
    ))
    shared = durable(shared_digests(marked.select(F.explode(F.array("d", "e")).alias("d"))))
    own = candidates(rows.select("d", "text"), shared)
    numbered = clashes(own.unionByName(edited_again(rows, marked, shared)), shared)
    found = name_contents(name_contents(marked, numbered, "d", "fingerprint"), numbered, "e", "edited_fingerprint")
    return found.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("d", "e").alias("near_edited"), "near_next",
    )


def edited_again(rows: DataFrame, marked: DataFrame, shared: DataFrame) -> DataFrame:
    """``d, text`` of the edited texts whose digest is shared, put together again from the few documents they need.

    A document is found by its id and the hash of its text, so that repeated or null ids do not meet each other.
    """
    wanted = marked.join(shared, (F.col("e.d1") == shared["d1"]) & (F.col("e.d2") == shared["d2"]), "left_semi")
    wanted = durable(wanted.select(F.struct("doc_id", "h").alias("mine"), "next", "e").distinct())
    ids = wanted.select(F.explode(F.array(F.xxhash64("mine"), F.xxhash64("next"))).alias("_h"))
    bits_of, bits = bit_table(ids, "_h", wanted.count() * 2)
    key = F.struct("doc_id", "h")
    near = maybe_in(rows.select(key.alias("_key"), F.xxhash64(key).alias("_h"), "text"), "_h", bits_of, bits).select("_key", "text").distinct()
    met = wanted.join(near.select(F.col("_key").alias("_mine"), "text"), F.col("mine") == F.col("_mine"))
    met = met.join(near.select(F.col("_key").alias("_theirs"), F.col("text").alias("_other")), F.col("next") == F.col("_theirs"))
    made = with_digest(met.select("e", edited_text("text", "_other").alias("text")), "text", "_again")
    return made.filter("_again = e").select(F.col("e").alias("d"), "text")


QUERIES = {"op4_fingerprints": op4_fingerprints}
ORACLE_SQL: dict[str, str] = {}
