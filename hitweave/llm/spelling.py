"""Spelling variants: words that differ by one edited code point, grouped under their far commoner spelling.

A word's letter-parity mask has one bit a letter class, set where the letter occurs an odd number of times. One inserted or deleted code point
flips one bit, a replaced one at most two, so that two near words agree on at least one of three bands of the mask. Words meet by an
equal band, are filtered by length and by differing mask bits, and are then verified. A band alone has few values, so the meeting key also holds one
half of the word: one edit leaves the front or the back half of the shorter word as it is. No near pair is lost by that, and
groups stay small as the vocabulary grows. Each pair is made once, under the first key that it shares, by the join itself.

Defined results: a null text has no words; very long texts are read whole; repeated rows count again; a null id stands as an empty string before
the colon of the damage rule; other columns are ignored, whatever their names; ties of count go to the least word in code-point order; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = (bytes(range(ord(c), ord(c) + 26)).decode() for c in "Aa")
#: A mask has a bit for each of a to z, and 38 bits that the other letters share; band ``j`` holds the bits ``j, j + 3, j + 6, ...``.
MASK_BITS, BANDS = 64, 3
BAND_BITS = [sum(1 << b for b in range(j, MASK_BITS, BANDS)) for j in range(BANDS)]
OTHERS = MASK_BITS - 26


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7) -> DataFrame:
    """``doc_id, run`` of every maximal run of at least ``least`` letters, A to Z lower-cased."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"{RUN}{{{least},}}"), F.lit(0))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(runs).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))


def damaged(runs: DataFrame, divisor: int = 31) -> DataFrame:
    """``word``: the run, less one code point where its checksum with the id is a multiple of ``divisor``."""
    check = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    cut = runs.withColumn("_h", check).withColumn("_at", F.pmod("_h", F.char_length("run")).cast("int"))
    less = F.concat(F.col("run").substr(F.lit(1), F.col("_at")), F.col("run").substr(F.col("_at") + 2, F.char_length("run")))
    return cut.select(F.when(F.col("_h") % divisor == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least: int = 7, times: int = 2) -> DataFrame:
    """``word, n`` of the words of at least ``least`` code points that occur at least ``times`` times."""
    return words.filter(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= times)


def parity_mask(word: Column) -> Column:
    """The letter-parity mask as a signed long."""

    def flip(mask: Column, letter: Column) -> Column:
        code = F.ascii(letter)
        plain = code.between(ord("a"), ord("z"))
        bit = F.when(plain, code - ord("a")).otherwise(F.pmod(code, F.lit(OTHERS)) + 26)
        return mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))

    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), flip)


def _keyed(words: DataFrame, drops: list[int]) -> DataFrame:
    """Each word under its band and half keys, as one whose near word's shorter length is its own less each of ``drops``."""
    shorter = F.char_length("word") - F.col("drop")
    front = (shorter / 2).cast("int")
    half = F.when(F.col("side") == 0, F.col("word").substr(F.lit(1), front)).otherwise(F.expr("right(word, length(word) - `drop` - int((length(word) - `drop`) / 2))"))
    value = reduce(lambda rest, j: F.when(F.col("band") == j, F.col("mask").bitwiseAND(F.lit(signed(BAND_BITS[j])))).otherwise(rest), range(BANDS), F.lit(None).cast("long"))
    spread = words.withColumn("drop", F.explode(F.array(*[F.lit(d) for d in drops])))
    spread = spread.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.explode(F.array(*[F.lit(j) for j in range(BANDS)])))
    return spread.select(F.xxhash64(shorter, "side", "band", half, value).alias("key"), "side", "band", "drop", "word", "mask")


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, b``: every pair of distinct ``word`` that differs by exactly one inserted, deleted or replaced code point, once; ``a`` is not the longer one."""
    masked = durable(words.select("word", parity_mask(F.col("word")).alias("mask")))
    left = _keyed(masked, [0]).select("key", "side", "band", F.col("word").alias("a"), F.col("mask").alias("mask_a"))
    right = _keyed(masked, [0, 1]).select("key", F.col("side").alias("side_b"), F.col("band").alias("band_b"), "drop", F.col("word").alias("b"), F.col("mask").alias("mask_b"))
    differ = F.col("mask_a").bitwiseXOR(F.col("mask_b"))
    first = reduce(lambda rest, j: F.when(differ.bitwiseAND(F.lit(signed(BAND_BITS[j]))) == 0, j).otherwise(rest), range(BANDS - 1, -1, -1), F.lit(-1))
    front = (F.char_length("a") / 2).cast("int")
    same_front = F.expr("left(a, int(length(a) / 2)) = left(b, int(length(a) / 2))")
    met = (
        (F.col("key") == F.col("key_b")) & (F.bit_count(differ) <= 2) & (F.col("side") == F.col("side_b")) & (F.col("band") == F.col("band_b"))
        & (F.col("band") == first) & (F.char_length("a") == F.char_length("b") - F.col("drop")) & ((F.col("drop") == 1) | (F.col("a") < F.col("b")))
        & (F.when(front > 0, same_front).otherwise(F.lit(True)) == (F.col("side") == 0)) & (F.levenshtein("a", "b", 1) == 1)
    )
    return left.join(right.withColumnRenamed("key", "key_b"), met).select("a", "b")


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """Of ``word, n``: adds ``n_near``, the number of near words, and ``form``, ``form_n``: the near word of largest ``n`` if that is ``factor`` times its own."""
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select(F.col("p.a").alias("_of"), F.col("p.b").alias("word"))
    rated = both.join(words, "word").groupBy("_of").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), "word")).alias("_best"))
    found = words.join(rated, words["word"] == rated["_of"], "left")
    far = -F.col("_best.m") >= factor * F.col("n")
    return found.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(far, F.col("_best.word")).alias("form"), F.when(far, -F.col("_best.m")).alias("form_n"),
    )


def with_roots(rows: DataFrame) -> DataFrame:
    """Adds ``root``: the last word reached by following ``form``, the word itself where there is none.

    Paths double each round; a form has ``factor`` times the count of its word, so rounds grow with the logarithm of a logarithm.
    """
    steps = durable(rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if steps.join(further, "root", "left_semi").isEmpty():
            break
        steps = durable(steps.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
    return rows.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, times: int = 2, factor: int = 10, divisor: int = 31) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    words = durable(vocabulary(damaged(word_runs(docs, id_col, text_col, least), divisor), least, times))
    rows = with_roots(durable(variants(words, factor)))
    return rows.select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, commoner form and root."""
    return spelling_groups(table(spark, sf_dir, "documents"))


#: CRC-32 of the bytes of a string in SQL: a table by the rule of the polynomial, then one step a byte.
CRC_TABLE = """crc AS (
            SELECT list(v ORDER BY i) AS t FROM (
                SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), list_transform(range(8), lambda x: CAST(0 AS BIGINT))), lambda a, b: xor(a >> 1, (a & 1) * 3988292384)) AS v
                FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of a string expression, given the table ``crc``."""
    byte = f"CAST(('0x' || hex(array_slice(encode({text}), k, k))) AS BIGINT)"
    steps = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda k: {byte})"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295)"


QUERIES = {"op13_spelling": op13_spelling}
ORACLE_SQL = {
    "op13_spelling": rf"""
        WITH RECURSIVE {CRC_TABLE},
        run AS (
            SELECT doc_id, translate(r, '{UPPER}', '{LOWER}') AS r, count(*) AS c
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents) GROUP BY ALL),
        summed AS (SELECT r, c, {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r")} AS h FROM run, crc WHERE length(r) >= 7),
        made AS (SELECT c, CASE WHEN h % 31 = 0 THEN r[1 : h % length(r)] || r[h % length(r) + 2 :] ELSE r END AS word FROM summed),
        words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
        cut AS (SELECT word, n, p, word[1 : p - 1] || word[p + 1 :] AS v FROM words, unnest(range(1, length(word) + 1)) u(p)),
        near AS (
            SELECT a.word AS a, b.word AS b, b.n AS bn FROM cut a JOIN cut b ON a.p = b.p AND a.v = b.v AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.v = b.word
            UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.v = b.word),
        best AS (SELECT a, count(*) AS n_near, min((-bn, b)) AS m FROM near GROUP BY a),
        formed AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -m[1] >= 10 * n THEN m[2] END AS form, CAST(CASE WHEN -m[1] >= 10 * n THEN -m[1] END AS BIGINT) AS form_n
            FROM words LEFT JOIN best ON a = word),
        way AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT w.word, f.word, f.form FROM way w JOIN formed f ON f.word = w.next)
        SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN way w ON w.word = f.word AND w.next IS NULL"""
}
