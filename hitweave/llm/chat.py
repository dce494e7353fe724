"""Chat formatting by quotation linking.

Messages may quote earlier ones in lines that start with ``>`` marks, one per
nesting level, attribution lines (``... wrote:``) above them. Each message is parsed
into its own text and its quoted passages by level. A passage is normalised
(case, white space) and hashed; so are the whole own text, blank-line paragraphs and lines of every message, and runs
of its lines that begin like a quoted passage and are as long. The hash join (SHA-256; only hashes and ids move) finds the
message a passage was taken from. A passage that is nowhere whole is looked up by its paragraphs, then by its
lines; lines count only if all that are found come from one message. A message replies to the original
of its first least-nested quotation, else to the message before it in its
conversation.

Replies form trees. Every message gets the root of its tree, ``thread_id``, and its ``depth``, also across conversations, so that
sorting by ``thread_id, depth, conv_id, position`` gives each thread in reply order, without quotes. A run of
messages that each reply to the one before is followed as a whole: only messages with a quotation are chased, by doubling.

Passages that many messages hold (a common line) are not resolved against
all of them: for each passage the earliest message of the same conversation, or else the earliest of all, is its original, so a
quotation has one original and no list of candidates is ever built. An original comes before its quotation: at an earlier turn of
the same conversation, or in a conversation of smaller id. Hence no message replies to itself over others.

Defined results: a null text counts as empty; rows repeated with the same ``(conv_id, turn)`` are told apart by
role and text; of rows repeated in all columns, which share a ``message_id``, each follows its copy; a null conversation is one of
its own, whose messages are roots and never linked; a null turn comes last; a message of any length is parsed whole; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bit_table, durable, lookup, maybe_in, table

MARKS = r"^\s*((?:>\s?)+)"
WROTE = r"^.*\bwrote:\s*$"
SALTS = 32

BLANK = r"\n\s*\n"
UNIT = "struct<kind:int,lines:array<string>>"


def quote_level(line: Column) -> Column:
    """Number of ``>`` marks a line starts with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), r"\s", ""))


def normalised(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"[\s>]+", " ")))


def lines_of(text: Column) -> Column:
    """Normalised lines that are not empty."""
    return F.filter(F.transform(F.split(text, r"\n"), lambda s: normalised(s)), lambda s: s != "")


def units(passage: Column) -> Column:
    """What a passage may be found by, each as its lines: itself (kind 0), its paragraphs (1) and its lines (2)."""

    def unit(kind: int, lines: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), lines.alias("lines"))

    paragraphs = F.filter(F.transform(F.split(passage, BLANK), lambda s: unit(1, lines_of(s))), lambda u: F.size(u["lines"]) > 0)
    lines = F.transform(lines_of(passage), lambda s: unit(2, F.array(s)))
    none = F.array().cast(f"array<{UNIT}>")
    return F.concat(F.array(unit(0, lines_of(passage))), F.when(F.size(paragraphs) > 1, paragraphs).otherwise(none), F.when(F.size(lines) > 1, lines).otherwise(none))


def passage_hash(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def ident(*names: str) -> Column:
    """SHA-256 of the columns, nulls told from texts."""
    parts = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c).cast("string"))) for c in names]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def parsed(messages: DataFrame) -> DataFrame:
    """Each message with ``own``, its text without quotes, ``passages``, its quoted passages
    ``(level, units)`` in order, ``paragraphs``, its own normalised texts that a passage may equal, and ``lines``, its own normalised ones."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), lambda s: F.struct(quote_level(s).alias("level"), F.regexp_replace(s, MARKS, "").alias("body"), s.alias("line")))
    rows = messages.withColumn("_lines", lines).withColumn("_quotes", F.exists("_lines", lambda s: s["level"] > 0))
    every = F.when(F.col("_quotes"), F.sequence(F.lit(0), F.size("_lines") - 1))
    rows = rows.withColumn("_starts", F.filter(every, lambda i: (i == 0) | (F.get("_lines", i)["level"] != F.get("_lines", i - 1)["level"])))

    def run(start: Column, number: Column) -> Column:
        size = F.coalesce(F.get("_starts", number + 1), F.size("_lines")) - start
        body = F.array_join(F.transform(F.slice("_lines", start + 1, size), lambda s: s["body"]), "\n")
        return F.struct(F.get("_lines", start)["level"].alias("level"), body.alias("body"))

    rows = rows.withColumn("_runs", F.transform("_starts", run))
    quoted = F.filter("_runs", lambda r: (r["level"] > 0) & (normalised(r["body"]) != ""))
    passages = F.transform(quoted, lambda r: F.struct(r["level"].alias("level"), units(r["body"]).alias("units")))
    plain = F.filter("_lines", lambda s: (s["level"] == 0) & ~s["line"].rlike(WROTE))
    own = F.regexp_replace(F.regexp_replace(F.array_join(F.transform(plain, lambda s: s["line"]), "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    rows = rows.withColumn("own", F.when(F.col("_quotes"), own).otherwise(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("passages", F.coalesce(passages, F.array().cast(f"array<struct<level:int,units:array<{UNIT}>>>")))
    rows = rows.withColumn("lines", lines_of(F.col("own")))
    pieces = F.transform(F.split("own", BLANK), lambda s: normalised(s))
    whole = F.concat(F.array(normalised(F.col("own"))), pieces, F.col("lines"))
    return rows.withColumn("paragraphs", F.array_distinct(F.filter(whole, lambda s: s != ""))).drop("_lines", "_quotes", "_starts", "_runs")


def quotations(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, message_id, level, at, unit, kind, k, n, begin``: everything that a message asks for, by hash."""
    asked = rows.filter(F.col("conv_id").isNotNull() & (F.size("passages") > 0)).select("conv_id", "turn", "message_id", F.posexplode("passages").alias("at", "p"))
    asked = asked.select("conv_id", "turn", "message_id", "at", "p.level", F.posexplode("p.units").alias("unit", "u"))
    return asked.select(
        "conv_id", "turn", "message_id", "level", "at", "unit", "u.kind", passage_hash(F.array_join("u.lines", " ")).alias("k"),
        F.size("u.lines").alias("n"), F.xxhash64(F.col("u.lines")[0]).alias("begin"),
    ).distinct()


def offers(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``k, conv_id, origin``: the least message of each conversation that holds what is ``wanted``, and some that hold other things."""
    rows = rows.filter(F.col("conv_id").isNotNull())
    origin = F.struct(F.col("turn").isNull().alias("n"), "turn", "message_id")
    asked = wanted.select(F.xxhash64("k").alias("h")).distinct()
    bits = bit_table(asked, "h", 1 << 22)
    held = rows.select("conv_id", origin.alias("origin"), F.explode("paragraphs").alias("norm")).select("conv_id", "origin", passage_hash(F.col("norm")).alias("k"))
    lengths = wanted.filter("n > 1").select("begin", "n").distinct()
    spread = lengths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    starts = rows.select("message_id", F.posexplode("lines").alias("at", "line")).select("message_id", "at", F.xxhash64("line").alias("begin"))
    starts = maybe_in(starts, "begin", *bit_table(lengths, "begin", 1 << 22)).withColumn("salt", F.pmod(F.xxhash64("message_id", "at"), F.lit(SALTS)).cast("int"))
    places = starts.join(spread, ["begin", "salt"]).groupBy("message_id").agg(F.collect_set(F.struct("at", "n")).alias("places")).withColumn("m", F.xxhash64("message_id"))
    long = rows.select("conv_id", "message_id", origin.alias("origin"), "lines", F.xxhash64("message_id").alias("m"))
    long = maybe_in(long, "m", *bit_table(places, "m", 1 << 22)).drop("m").join(places.drop("m"), "message_id")
    inside = F.filter("places", lambda p: p["at"] + p["n"] <= F.size("lines"))
    norms = F.transform(inside, lambda p: F.array_join(F.slice("lines", p["at"] + 1, p["n"]), " "))
    runs = long.select("conv_id", "origin", F.explode(norms).alias("norm")).select("conv_id", "origin", passage_hash(F.col("norm")).alias("k"))
    met = maybe_in(held.unionByName(runs).withColumn("h", F.xxhash64("k")), "h", *bits)  # so that only hashes which may be asked for move
    return met.groupBy("k", "conv_id").agg(F.min("origin").alias("origin"))


def originals(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``message_id, quoted_id``: the message that each message quotes first at the least level, where it is found."""
    offered = durable(offers(rows, wanted))
    both = F.concat(F.hex("k"), F.lit(":"), F.col("conv_id").cast("string"))
    asked = wanted.withColumn("here", both).withColumn("there", F.hex("k"))
    near = asked.groupBy("here").count().join(offered.select(both.alias("here"), "origin"), "here")
    far = offered.groupBy("k").agg(F.min(F.struct("conv_id", "origin")).alias("far")).select(F.hex("k").alias("there"), "far")
    far = asked.groupBy("there").agg(F.count("*").alias("rows")).join(far, "there")
    total = wanted.count()
    found = lookup(lookup(asked, durable(near), "here", "count", total), durable(far), "there", "rows", total)
    earlier = ~F.col("origin.n") & (F.col("turn").isNull() | (F.col("origin.turn") < F.col("turn")))
    other = F.when(F.col("far.conv_id") < F.col("conv_id"), F.col("far.origin.message_id"))
    found = found.withColumn("original", F.when(F.col("origin").isNull(), other).otherwise(F.when(earlier, F.col("origin.message_id")))).filter("original is not null")
    lines = found.filter("kind = 2").groupBy("message_id", "level", "at").agg(F.min("original").alias("original"), F.max("original").alias("last")).filter("original = last")
    lines = lines.select("message_id", "level", "at", F.lit(2).alias("kind"), F.lit(0).alias("unit"), "original")
    best = found.filter("kind < 2").select("message_id", "level", "at", "kind", "unit", "original").unionByName(lines)
    first = best.groupBy("message_id").agg(F.min(F.struct("level", "at", "kind", "unit", "original")).alias("m"))
    return first.select("message_id", F.col("m.original").alias("quoted_id"))


def in_order(rows: DataFrame, turns_per_range: int = 256) -> DataFrame:
    """Of distinct messages with their ``copies``: adds ``position`` in the conversation, ``previous_id``, and ``head``, the last message
    with ``heads`` up to this one, or else the first of the conversation, with its position.

    Long conversations are ranked by ranges of turns, messages without a turn by ranges of their id.
    """
    conv = F.struct(F.col("conv_id").isNull().alias("null"), "conv_id")
    rest = F.conv(F.substring("message_id", 1, 2), 16, 10).cast("long") + (1 << 62)
    rows = rows.withColumn("_conv", conv).withColumn("_range", F.coalesce(F.expr(f"turn div {turns_per_range}"), rest))
    order = [F.asc_nulls_last("turn"), F.when(F.col("turn").isNotNull(), F.col("role")), "message_id"]
    inside = Window.partitionBy("_conv", "_range").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_at", F.sum("copies").over(so_far) - F.col("copies")).withColumn("_prev", F.lag("message_id").over(inside))
    head = F.when(F.col("heads"), F.struct("message_id", F.col("_at").alias("at"), F.col("_range").alias("range")))
    placed = placed.withColumn("_head", F.last(head, ignorenulls=True).over(so_far))
    counts = placed.groupBy("_conv", "_range").agg(F.sum("copies").alias("_n"), F.max(F.struct("_at", "message_id")).alias("_top"), F.min(F.struct("_at", "message_id")).alias("_bottom"), F.max(F.struct("_head.at", "_head")).alias("_last"))
    before = Window.partitionBy("_conv").orderBy("_range")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.col("_last._head").isNotNull(), F.struct(F.col("_last._head.message_id").alias("message_id"), (F.col("_last._head.at") + F.col("_shift")).alias("at")))
    shifts = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn("_far", last)
    opening = F.struct(F.first("_bottom.message_id").over(before).alias("message_id"), F.lit(0).cast("long").alias("at"))
    shifts = shifts.select("_conv", "_range", "_shift", F.lag("_top.message_id").over(before).alias("_carried"), F.coalesce(F.last("_far", ignorenulls=True).over(earlier), opening).alias("_far"))
    placed = placed.join(shifts, ["_conv", "_range"])
    near = F.when(F.col("_head").isNotNull(), F.struct(F.col("_head.message_id").alias("message_id"), (F.col("_head.at") + F.col("_shift")).alias("at")))
    previous = F.when(F.col("conv_id").isNotNull(), F.coalesce("_prev", "_carried"))
    return placed.withColumn("position", F.col("_at") + F.col("_shift")).withColumn("previous_id", previous).withColumn("head", F.coalesce(near, "_far")).drop(
        "_conv", "_range", "_at", "_prev", "_head", "_shift", "_carried", "_far")


def threads(placed: DataFrame) -> DataFrame:
    """Adds ``thread_id`` and ``depth``: the root of the tree of replies and the number of replies up to it."""
    step = F.col("position") - F.col("head.at")
    jumps = placed.filter("quoted_id is not null").select(F.col("message_id").alias("jump"), F.col("quoted_id"))
    met = jumps.join(placed.select(F.col("message_id").alias("quoted_id"), F.col("head.message_id").alias("up"), (step + 1).alias("depth")), "quoted_id")
    jumps = durable(met.select("jump", "up", "depth"))
    while True:
        over = jumps.select(F.col("jump").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        if jumps.join(over, "up", "left_semi").isEmpty():
            break
        jumps = durable(jumps.join(over, "up", "left").select("jump", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")))
    joined = placed.withColumn("_head", F.col("head.message_id")).join(jumps.select(F.col("jump").alias("_head"), "up", F.col("depth").alias("_over")), "_head", "left")
    return joined.withColumn("thread_id", F.coalesce("up", "_head")).withColumn("depth", (F.coalesce("_over", F.lit(0)) + step).cast("long")).drop("_head", "up", "_over", "head")


def conversations(messages: DataFrame) -> DataFrame:
    """One row a message, without quotes: ``conv_id, position, turn, role, content, message_id, parent_id, link, thread_id, depth``.

    ``link``: ``quote`` where a quotation was found, ``order`` for the message before, ``root`` for neither.
    """
    rows = parsed(messages.select("conv_id", "turn", "role", "text")).withColumn("message_id", ident("conv_id", "turn", "role", "text"))
    wanted = durable(quotations(rows))
    compact = rows.groupBy("message_id", "conv_id", "turn", "role").agg(F.count("*").alias("copies"))
    if wanted.isEmpty():
        compact = compact.withColumn("quoted_id", F.lit(None).cast("string"))
    else:
        compact = compact.join(originals(rows, wanted), "message_id", "left")
    placed = in_order(compact.withColumn("heads", F.col("quoted_id").isNotNull() | F.col("conv_id").isNull()))
    placed = threads(durable(placed)) if not wanted.isEmpty() else placed.select(
        "*", F.col("head.message_id").alias("thread_id"), (F.col("position") - F.col("head.at")).cast("long").alias("depth")).drop("head")
    texts = rows.groupBy("message_id").agg(F.first("own").alias("content"))
    found = texts.join(placed, "message_id").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    again = (F.col("copy") > 0) & F.col("conv_id").isNotNull()
    parent = F.when(again, F.col("message_id")).otherwise(F.coalesce("quoted_id", "previous_id"))
    link = F.when(parent.isNull(), "root").when(again | F.col("quoted_id").isNull(), "order").otherwise("quote")
    return found.select(
        "conv_id", (F.col("position") + F.col("copy")).alias("position"), "turn", "role", "content", "message_id", parent.alias("parent_id"), link.alias("link"),
        "thread_id", F.when(again, F.col("depth") + F.col("copy")).otherwise(F.col("depth")).alias("depth"),
    )


def rendered(role: Column, content: Column) -> Column:
    """A message in chat mark-up."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("user")), F.lit("|>\n"), content, F.lit("\n"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of all conversations with their place, parent and thread, without quotes, in chat mark-up."""
    rows = conversations(table(spark, sf_dir, "conversations"))
    chat = rendered(F.col("role"), F.col("content"))
    return rows.select(
        "conv_id", "position", "turn", "role", "link", "message_id", "parent_id", "thread_id", "depth",
        F.length("content").cast("long").alias("n_chars"), F.sha2(chat, 256).alias("chat_sha256"),
    )


QUERIES = {"op9_chat": op9_chat}
NORM = "trim(lower(regexp_replace({}, '[\\s>]+', ' ', 'g')))"
LINES = "list_filter(list_transform(string_split({}, chr(10)), lambda s: " + NORM.format("s") + "), lambda s: s <> '')"
ORACLE_SQL = {
    "op9_chat": rf"""
        WITH RECURSIVE cut AS (
            SELECT *, sha256(concat_ws(chr(31), {", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE '+' || CAST({c} AS VARCHAR) END" for c in ("conv_id", "turn", "role", "text"))})) AS message_id,
                   list_transform(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)), lambda s:
                       {{'q': length(regexp_replace(regexp_extract(s, '^\s*((?:>\s?)+)', 1), '\s', '', 'g')), 'b': regexp_replace(s, '^\s*((?:>\s?)+)', ''), 's': s}}) AS ls
            FROM conversations),
        own AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, CASE WHEN turn IS NOT NULL THEN role END, message_id) - 1 AS position,
                   CASE WHEN len(list_filter(ls, lambda x: x.q > 0)) = 0 THEN coalesce(text, '')
                   ELSE regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(ls, lambda x: x.q = 0
                       AND NOT regexp_matches(x.s, '^.*\bwrote:\s*$')), lambda x: x.s), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') END AS content
            FROM cut),
        held AS (SELECT *, {LINES.format("content")} AS lines, list_transform(string_split_regex(content, '\n\s*\n'), lambda s: {NORM.format("s")}) AS parts FROM own),
        one AS (SELECT DISTINCT conv_id, turn, message_id, ls FROM held WHERE conv_id IS NOT NULL AND len(list_filter(ls, lambda x: x.q > 0)) > 0),
        line AS (SELECT conv_id, turn, message_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM one),
        edge AS (SELECT *, CASE WHEN l.q = lag(l.q) OVER w THEN 0 ELSE 1 END AS e FROM line WINDOW w AS (PARTITION BY message_id ORDER BY i)),
        run AS (SELECT *, sum(e) OVER (PARTITION BY message_id ORDER BY i) AS r FROM edge),
        passage AS (SELECT conv_id, turn, message_id, r AS nth, any_value(l.q) AS level, string_agg(l.b, chr(10) ORDER BY i) AS body FROM run GROUP BY conv_id, turn, message_id, r),
        split AS (SELECT *, {LINES.format("body")} AS pl, list_filter(list_transform(string_split_regex(body, '\n\s*\n'), lambda s: {LINES.format("s")}), lambda u: len(u) > 0) AS pp FROM passage WHERE level > 0),
        unit AS (
            SELECT conv_id, turn, message_id, level, nth, 0 AS kind, 0 AS unit, pl AS u FROM split WHERE len(pl) > 0
            UNION ALL SELECT conv_id, turn, message_id, level, nth, 1, unnest(range(len(pp))), unnest(pp) FROM split WHERE len(pp) > 1
            UNION ALL SELECT conv_id, turn, message_id, level, nth, 2, unnest(range(len(pl))), unnest(list_transform(pl, lambda s: [s])) FROM split WHERE len(pl) > 1),
        asked AS (SELECT *, array_to_string(u, ' ') AS norm FROM unit),
        met AS (
            SELECT a.*, h.conv_id AS oc, h.turn AS ot, h.message_id AS oid FROM asked a JOIN held h ON h.conv_id IS NOT NULL AND (h.conv_id <= a.conv_id) AND (
                {NORM.format("h.content")} = a.norm OR list_contains(h.parts, a.norm) OR list_contains(h.lines, a.norm)
                OR (len(a.u) > 1 AND len(list_filter(range(1, len(h.lines) - len(a.u) + 2), lambda k: h.lines[k] = a.u[1] AND array_to_string(h.lines[k : k + len(a.u) - 1], ' ') = a.norm)) > 0))),
        best AS (
            SELECT message_id, conv_id, turn, level, nth, kind, unit, bool_or(oc = conv_id) AS near,
                   min((ot IS NULL, ot, oid)) FILTER (WHERE oc = conv_id) AS o, min((oc, ot IS NULL, ot, oid)) AS f FROM met GROUP BY ALL),
        origin AS (
            SELECT message_id, level, nth, kind, unit, CASE WHEN near THEN (CASE WHEN NOT o[1] AND (turn IS NULL OR o[2] < turn) THEN o[3] END)
                   WHEN f[1] < conv_id THEN f[4] END AS q FROM best),
        choice AS (
            SELECT message_id, level, nth, kind, unit, q FROM origin WHERE kind < 2 AND q IS NOT NULL
            UNION ALL SELECT message_id, level, nth, 2, 0, min(q) FROM origin WHERE kind = 2 AND q IS NOT NULL GROUP BY message_id, level, nth HAVING min(q) = max(q)),
        quoted AS (SELECT message_id, arg_min(q, (level, nth, kind, unit, q)) AS quoted_id FROM choice GROUP BY message_id),
        linked AS (
            SELECT o.*, CASE WHEN o.conv_id IS NULL THEN NULL WHEN lag(o.message_id) OVER w = o.message_id THEN o.message_id
                       ELSE coalesce(q.quoted_id, lag(o.message_id) OVER w) END AS parent_id,
                   CASE WHEN o.conv_id IS NOT NULL AND lag(o.message_id) OVER w = o.message_id THEN NULL ELSE q.quoted_id END AS quoted_id,
                   CASE WHEN lag(o.message_id) OVER w = o.message_id THEN false ELSE true END AS lead
            FROM own o LEFT JOIN quoted q USING (message_id) WINDOW w AS (PARTITION BY o.conv_id ORDER BY position)),
        placed AS (
            SELECT l.*, CASE WHEN l.quoted_id IS NOT NULL THEN p.conv_id WHEN l.parent_id IS NOT NULL THEN l.conv_id END AS parent_conv,
                   CASE WHEN l.quoted_id IS NOT NULL THEN p.position WHEN l.parent_id IS NOT NULL THEN l.position - 1 END AS parent_position
            FROM linked l LEFT JOIN linked p ON p.message_id = l.quoted_id AND p.lead),
        tree AS (
            SELECT *, message_id AS thread_id, CAST(0 AS BIGINT) AS depth FROM placed WHERE parent_id IS NULL
            UNION ALL
            SELECT l.*, t.thread_id, t.depth + 1 FROM tree t JOIN placed l ON l.parent_conv = t.conv_id AND l.parent_position = t.position)
        SELECT conv_id, position, turn, role, CASE WHEN parent_id IS NULL THEN 'root' WHEN quoted_id IS NULL THEN 'order' ELSE 'quote' END AS link,
               message_id, parent_id, thread_id, depth, CAST(length(content) AS BIGINT) AS n_chars,
               sha256('<|' || coalesce(role, 'user') || '|>' || chr(10) || content || chr(10)) AS chat_sha256
        FROM tree"""
}
