"""Repair of conversations at least cost: messages are kept, given another role, deleted or inserted until the roles read ``s?(ua)+``, or nothing is left.

A conversation is a shortest-path problem. Nodes are the gaps between its messages with one of four states (nothing yet, system, user, assistant said
last); arcs are the edits with costs of 0 to 6. Costs being small integers, Dial's queue of buckets settles nodes in order of distance to the goal, backwards; then the arcs on which
the distance falls by just their cost are walked from the start, the least letter first, which gives the least audit of the cheapest.

Messages travel as one code each. All are sorted over all tasks by conversation and turn; each task cuts what it has of a conversation into blocks of bounded size. A
conversation in one block is solved there. Of longer ones each block gives the costs from any state at its beginning to any at its end; a scan over these four-by-four tables from the end, one row a block,
gives the distances at every block's end, with which the blocks are walked from all four states, in parallel; a scan of where these walks end picks one walk a block.
Texts move once, to be joined to their edits in order.

Defined results: null roles and texts count as one space, in the damage rule null ids and turns too; a null conversation is one conversation of its own; messages of one
turn are taken by role, then by SHA-256 of the text; a null turn comes first; repeated rows are duplicates of the first of them; a role without an initial cannot be kept; very long texts are read
whole; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import durable, table
from .spelling import CRC_TABLE, crc_sql

BLANK, END = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: States: nothing yet, system, user, assistant said last. A conversation may end in the first and the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Initials that may follow a state, and the state then reached.
FOLLOW = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: The state after a user or assistant message that is put in or made of another.
TURN = [USER, USER, ASSISTANT, USER]
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
NEVER = 1 << 60
#: Costs of ending a conversation from each state, by inserts alone.
ENDING = (0, 2 * INSERT, INSERT, 0)
SPEAKER = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
#: Places in "sua" of the initials that may stand side by side.
LEGAL = ((0, 1), (1, 2), (2, 1))
#: A message's code: the place of its role's initial in "sua" or 3, then 4 if it was cut off, 8 if it has to go.
CUT_OFF_CODE, GONE = 4, 8


def arcs(code: int | None, state: int) -> list[tuple[str, int, int, int]]:
    """Edits ``(letter, cost, state after, messages read)`` in a state before a message of that code, or at the end; letters in ASCII order."""
    found = [("I", INSERT, TURN[state], 0)]
    if code is None:
        return found
    if code & GONE:
        return [("D", DELETE, state, 1), *found]
    late = CUT_OFF if code & CUT_OFF_CODE else 0
    after = FOLLOW[state].get("sua?"[code & 3])
    kept = [] if after is None else [("K", KEEP + late, after, 1)]
    return [("D", DELETE, state, 1), *found, *kept, ("R", REROLE + late, TURN[state], 1)]


#: Of each code, the arcs by which a state may be reached backwards: ``(cost, state before)`` by the state after, for arcs that read a message.
BACK = [[[(cost, s) for s in range(4) for _, cost, after, read in arcs(code, s) if read and after == t] for t in range(4)] for code in range(12)]
BACK_INSERT = [[s for s in range(4) if TURN[s] == t] for t in range(4)]
WALK = [[arcs(code, s) for s in range(4)] for code in range(12)]


def distances(codes: bytes, goal: tuple[int, ...]) -> list[int]:
    """Least cost from node ``4 * place + state`` to the end, where state ``t`` still costs ``goal[t]``, inserts there included: Dial's buckets, settled backwards."""
    size = 4 * (len(codes) + 1)
    least = [NEVER] * size
    buckets: list[list[int]] = []

    def put(node: int, cost: int) -> None:
        if cost < least[node]:
            least[node] = cost
            while len(buckets) <= cost - base:
                buckets.append([])
            buckets[cost - base].append(node)

    base, last = min(goal), 4 * len(codes)
    if base >= NEVER:
        return least
    for state, cost in enumerate(goal):
        if cost < NEVER:
            put(last + state, cost)
    cost = base
    while cost - base < len(buckets):
        for node in buckets[cost - base]:  # no edit costs less than nothing: what joins this bucket is read in this loop
            if least[node] != cost:
                continue
            place, state = node >> 2, node & 3
            if place < len(codes):
                for s in BACK_INSERT[state]:
                    put(4 * place + s, cost + INSERT)
            if place:
                for step, s in BACK[codes[place - 1]][state]:
                    put(4 * (place - 1) + s, cost + step)
        buckets[cost - base] = []
        cost += 1
    return least


def walk(codes: bytes, state: int, least: list[int]) -> tuple[str, int]:
    """The ASCII-least letters along tight arcs from a state at the beginning, and the state in which the last message is left."""
    place, letters = 0, []
    while place < len(codes):
        here = least[4 * place + state]
        for letter, cost, after, read in WALK[codes[place]][state]:
            if least[4 * (place + read) + after] + cost == here:
                letters.append(letter)
                place, state = place + read, after
                break
    return "".join(letters), state


def closing(state: int) -> str:
    return "I" * (ENDING[state] // INSERT)


@lru_cache(1 << 14)
def solved(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    least = distances(codes, ENDING)
    letters, state = walk(codes, NOTHING, least)
    return least[NOTHING], letters + closing(state)


def costs_through(codes: bytes) -> list[int]:
    """Of each state at the beginning of a block, the costs of leaving it in each state; inserts after its last message are the next block's."""
    columns = [distances(codes, tuple(0 if t == end else NEVER for t in range(4))) for end in range(4)]
    return [columns[end][start] for start in range(4) for end in range(4)]


def damaged(messages: DataFrame) -> DataFrame:
    """The ``conv_id, turn, role, text`` of messages after the damage that their conversation and turn draw, nulls as one space."""
    spelt = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))  # noqa: E731
    draw = F.crc32(F.concat(spelt("conv_id"), F.lit(":"), spelt("turn")).cast("binary")) % 20
    rows = messages.select("conv_id", "turn", spelt("role").alias("role"), spelt("text").alias("text"), draw.alias("_draw")).filter("_draw != 0")
    text = F.when(F.col("_draw") == 1, "").when(F.col("_draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_draw") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def with_digest(messages: DataFrame) -> DataFrame:
    return messages.withColumn("digest", F.unhex(F.sha2("text", 256)))


def marked(messages: DataFrame) -> DataFrame:
    """Distinct messages ``conv_id, turn, role, digest`` with their ``copies`` and whether they are ``blank``, ``cut_off`` or said ``earlier`` in the conversation."""
    facts = with_digest(messages).select(
        "conv_id", "turn", "role", "digest", (~F.col("text").rlike(BLANK)).alias("blank"), (~F.col("text").rlike(END)).alias("cut_off"),
    )  # fmt: skip
    lines = durable(facts.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("copies"), F.first("blank").alias("blank"), F.first("cut_off").alias("cut_off")))
    order = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    said = lines.filter("NOT blank").groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first"), F.count("*").alias("times")).filter("times > 1")
    said = said.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    again = lines.join(said, same, "left").withColumn("earlier", F.col("first").isNotNull() & (F.col("first") < order))
    return again.drop("_conv", "_role", "_digest", "first")


def initial() -> Column:
    return F.coalesce(F.expr("nullif(instr('sua', left(role, 1)) * sign(length(role)), 0)"), F.lit(4)).cast("int") - 1


def streamed(rows: DataFrame, schema: T.StructType, fold: Callable[[Iterator[tuple]], Iterator[tuple]], at_once: int = 1024) -> DataFrame:
    """The rows that ``fold`` makes of the rows of each task, in their order; a few are held at a time."""
    arrow = to_arrow_schema(schema)

    def batch(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], f.type) for i, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for row in fold(chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)):
            made.append(row)
            if len(made) >= at_once:
                yield batch(made)
                made = []
        if made:
            yield batch(made)

    return rows.mapInArrow(run, schema)


def fields(rows: DataFrame, names: str, more: str = "") -> T.StructType:
    """The named columns' fields, then those of a DDL string."""
    made = T.StructType([T.StructField(n, rows.schema[n].dataType) for n in names.split()])
    return T.StructType([*made, *T.StructType.fromDDL(more)]) if more else made


def in_blocks(lines: DataFrame, least: int = 1 << 12, most: int = 1 << 17) -> DataFrame:
    """All messages in order as ``codes`` in blocks: ``conv_id, turn, role, digest`` of the first message, ``task`` and ``number`` in the task, ``illegal``
    neighbours inside, and the initials' places at both ends.

    A block holds at least ``least`` codes where a conversation has them, and so many that there are about ``most`` full ones.
    """
    order = [F.col("conv_id").isNotNull(), F.col("conv_id"), F.col("turn").isNotNull(), F.col("turn"), F.col("role"), F.col("digest")]
    code = F.col("initial") + F.when(F.col("blank") | F.col("earlier"), GONE).when(F.col("cut_off"), CUT_OFF_CODE).otherwise(0)
    coded = lines.withColumn("initial", initial()).select("conv_id", "turn", "role", "digest", "copies", "initial", code.cast("int").alias("code"))
    coded = durable(coded)
    size = max(least, (coded.agg(F.sum("copies")).first()[0] or 0) // most)
    dealt = durable(coded.repartitionByRange(*order).sortWithinPartitions(*order))

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        task, number, head, codes = TaskContext.get().partitionId(), 0, None, bytearray()

        def block() -> tuple:
            marks = bytes(c & 3 for c in codes)
            good = sum(marks.count(bytes(pair)) for pair in LEGAL)  # no legal pair overlaps itself
            return (*head, task, number, bytes(codes), len(marks) - 1 - good, marks[0], marks[-1])

        for conv, turn, role, digest, copies, mark, code in rows:
            for at in range(0, copies, size):
                some = min(size, copies - at)
                if codes and (head[0] != conv or len(codes) + some > size):
                    yield block()
                    number, codes = number + 1, bytearray()
                if not codes:
                    head = (conv, turn, role, digest)
                codes += bytes([mark + GONE if at else code]) + bytes([mark + GONE]) * (some - 1)
        if codes:
            yield block()

    return streamed(dealt, fields(dealt, "conv_id turn role digest", "task long, number long, codes binary, illegal long, first int, last int"), fold)


def walked(blocks: DataFrame) -> DataFrame:
    """Blocks with their part of the ``audit``; the first of a conversation has its ``cost``; ``illegal`` counts the neighbour before the block too."""
    place = "conv_id turn role digest task number illegal"
    long = blocks.groupBy("conv_id").agg(F.count("*").alias("blocks")).filter("blocks > 1").select(F.col("conv_id").alias("_conv"))
    of_long = F.col("conv_id").eqNullSafe(F.col("_conv"))
    short = streamed(
        blocks.join(long, of_long, "left_anti").select(*place.split(), "codes"), fields(blocks, place, "cost long, audit string"),
        lambda rows: ((*row[:-1], *solved(row[-1])) for row in rows),
    )  # fmt: skip
    many = durable(blocks.join(long, of_long, "left_semi"))
    if many.isEmpty():
        return short

    key, by = ["task", "number"], [F.col("conv_id").isNotNull(), F.col("conv_id")]
    tables = streamed(many.select("conv_id", *key, "codes"), fields(many, "conv_id task number", "costs array<long>"), lambda rows: ((*row[:-1], costs_through(row[-1])) for row in rows))
    backwards = tables.repartition("conv_id").sortWithinPartitions(*by, F.desc("task"), F.desc("number"))

    def goals(rows: Iterator[tuple]) -> Iterator[tuple]:
        last, goal = [], ENDING
        for conv, task, number, costs in rows:
            goal = goal if last == [conv] else ENDING
            last = [conv]
            yield task, number, list(goal)
            goal = tuple(min(NEVER, *(costs[4 * s + t] + goal[t] for t in range(4))) for s in range(4))

    goal = streamed(backwards, fields(many, "task number", "goal array<long>"), goals)

    def walks(rows: Iterator[tuple]) -> Iterator[tuple]:
        for *row, codes, goal in rows:
            least = distances(codes, tuple(goal))
            found = [walk(codes, s, least) if least[s] < NEVER else ("", 0) for s in range(4)]
            yield *row, least[NOTHING], [a for a, _ in found], [s for _, s in found]

    columns = f"{place} first last"
    tried = durable(streamed(many.join(goal, key).select(*columns.split(), "codes", "goal"), fields(many, columns, "cost long, audits array<string>, ends array<int>"), walks))
    onwards = tried.select("conv_id", *key, "first", "last", "ends").repartition("conv_id").sortWithinPartitions(*by, "task", "number")

    def states(rows: Iterator[tuple]) -> Iterator[tuple]:
        held = None
        for conv, task, number, first, last, ends in rows:
            new = held is None or held[0] != conv
            if held and new:
                yield *held[1], closing(held[2])
            elif held:
                yield *held[1], ""
            state = NOTHING if new else held[2]
            strange = 0 if new else int((held[3], first) not in LEGAL)
            held = (conv, (task, number, state, new, strange), ends[state], last)
        if held:
            yield *held[1], closing(held[2])

    picked = streamed(onwards, fields(many, "task number", "state int, opens boolean, strange int, closing string"), states)
    found = tried.join(picked, key).withColumn("audit", F.concat(F.element_at("audits", F.col("state") + 1), "closing"))
    found = found.withColumn("cost", F.when(F.col("opens"), F.col("cost"))).withColumn("illegal", F.col("illegal") + F.col("strange"))
    return short.unionByName(found.select(short.columns))


def repaired(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """One row an edit, in order inside each task: ``conv_id, edit, turn, role, text``, the message as repaired, or as it was where it is deleted.

    ``parts`` are the walked blocks of ``messages``. All rows of a conversation are in one task and pass through it one by one.
    """
    columns = ["conv_id", "turn", "role", "digest", "kind", "task", "number", "text"]
    pieces = parts.select("conv_id", "turn", "role", "digest", F.lit(0).alias("kind"), "task", "number", F.col("audit").alias("text"))
    said = with_digest(messages).select("conv_id", "turn", "role", "digest", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("task"), F.lit(0).cast("long").alias("number"), "text")
    order = [F.col("conv_id").isNotNull(), F.col("conv_id"), F.col("turn").isNotNull(), F.col("turn"), *columns[2:7]]
    rows = pieces.unionByName(said).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "kind", "text")

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        last, letters, at, state = [], "", 0, NOTHING

        def inserted(conv: object) -> Iterator[tuple]:
            nonlocal at, state
            while at < len(letters) and letters[at] == "I":
                at, state = at + 1, TURN[state]
                yield conv, "I", None, SPEAKER[state], ""

        for conv, turn, role, kind, text in rows:
            if last != [conv]:
                if last:
                    yield from inserted(last[0])
                last, letters, at, state = [conv], "", 0, NOTHING
            if kind == 0:
                letters, at = letters[at:] + text, 0
                continue
            yield from inserted(conv)
            edit, at = letters[at], at + 1
            if edit != "D":
                state = FOLLOW[state][role[0]] if edit == "K" else TURN[state]
            yield conv, edit, turn, SPEAKER[state] if edit == "R" else role, text
        if last:
            yield from inserted(last[0])

    return streamed(rows, fields(messages, "conv_id", "edit string").add(messages.schema["turn"]).add("role", "string").add("text", "string"), fold)


def digests(edits: DataFrame) -> DataFrame:
    """``conv_id, audit, repaired_sha256`` of the rows of :func:`repaired`, whose order inside their tasks it needs; texts are hashed as they pass."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        last, letters, digest, any_yet = [], [], hashlib.sha256(), False
        for conv, edit, _, role, text in rows:
            if last != [conv]:
                if last:
                    yield last[0], "".join(letters), digest.hexdigest()
                last, letters, digest, any_yet = [conv], [], hashlib.sha256(), False
            letters.append(edit)
            if edit != "D":
                digest.update((("\n" if any_yet else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                any_yet = True
        if last:
            yield last[0], "".join(letters), digest.hexdigest()

    return streamed(edits, fields(edits, "conv_id", "audit string, repaired_sha256 string"), fold)


def repair_report(original: DataFrame, messages: DataFrame, least: int = 1 << 12) -> DataFrame:
    """Faults, cost, audit and digest of every conversation of ``original``, whose messages are now ``messages`` (``conv_id, turn, role, text``, none of the last two null)."""
    lines = marked(messages)
    fresh = ~F.col("blank") & ~F.col("earlier")
    facts = lines.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("copies"))).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("copies") - F.when(F.col("earlier"), 0).otherwise(1))).alias("duplicate"),
        F.sum(F.when(fresh & F.col("cut_off"), F.lit(1).cast("long"))).alias("truncated"),
    ).withColumnRenamed("conv_id", "_of")  # fmt: skip
    parts = durable(walked(durable(in_blocks(lines, least))))
    sums = parts.groupBy(F.col("conv_id").alias("_in")).agg(F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"))
    made = digests(repaired(messages, parts)).withColumnRenamed("conv_id", "_as")
    found = original.select("conv_id").distinct()
    for other, name in ((facts, "_of"), (sums, "_in"), (made, "_as")):
        found = found.join(other, F.col("conv_id").eqNullSafe(F.col(name)), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256().hexdigest())
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule and repaired at least cost."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_report(rows, damaged(rows))


def _oracle() -> str:
    """The repair as a recursion over the messages of a conversation, which keeps the cheapest and then least audit of every state."""
    kind = "STRUCT(c BIGINT, a VARCHAR, r VARCHAR[])"

    def step(z: str, cost: str, letter: str, line: str = "", when: str = "true") -> str:
        said = f"list_append({z}.r, {line})" if line else f"{z}.r"
        return f"CASE WHEN {z} IS NOT NULL AND {when} THEN CAST({{'c': {z}.c + {cost}, 'a': {z}.a || '{letter}', 'r': {said}}} AS {kind}) END"

    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    turn, names = (2, 2, 3, 2), {2: "user", 3: "assistant"}
    into: list[list[str]] = [[step(f"z{s}", "4", "D")] for s in range(4)]
    for (s, i), t in after.items():
        into[t].append(step(f"z{s}", "late", "K", "role || ':' || text", f"NOT gone AND left(role, 1) = '{i}'"))
    for s, t in enumerate(turn):
        into[t].append(step(f"z{s}", "3 + late", "R", f"'{names[t]}:' || text", "NOT gone"))
    read = ", ".join(f"least({', '.join(x)}) AS y{t}" for t, x in enumerate(into))
    u, a = "'user:'", "'assistant:'"
    closed = f"y0 AS z0, y1 AS z1, least(y2, {', '.join(step(f'y{s}', '3', 'I', u) for s in (0, 1, 3))}) AS z2"
    closed += f", least(y3, {step('y2', '3', 'I', a)}, " + ", ".join(f"CASE WHEN y{s} IS NOT NULL THEN CAST({{'c': y{s}.c + 6, 'a': y{s}.a || 'II', 'r': list_concat(y{s}.r, [{u}, {a}])}} AS {kind}) END" for s in (0, 1)) + ") AS z3"
    none = f"CAST(NULL AS {kind})"
    return rf"""
        WITH RECURSIVE {CRC_TABLE},
        drawn AS (
            SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') AS k, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS d
            FROM conversations, crc),
        hurt AS (
            SELECT k, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
            FROM drawn WHERE d <> 0),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM hurt),
        seen AS (
            SELECT *, NOT regexp_matches(text, '[^ 	-]') AS blank, row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS again,
                   NOT regexp_matches(text, '[.!?][ 	-]*$') AS cut_off, left(lag(role) OVER (PARTITION BY k ORDER BY i), 1) || left(role, 1) AS pair
            FROM numbered),
        rows AS (SELECT *, blank OR again AS gone, CASE WHEN NOT blank AND NOT again AND cut_off THEN 3 ELSE 0 END AS late FROM seen),
        facts AS (
            SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
                   count(*) FILTER (late > 0) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
            FROM rows GROUP BY k),
        way AS (
            SELECT k, CAST(0 AS BIGINT) AS i, {closed} FROM (SELECT k, CAST({{'c': 0, 'a': '', 'r': []}} AS {kind}) AS y0, {none} AS y1, {none} AS y2, {none} AS y3 FROM facts)
            UNION ALL
            SELECT k, i, {closed} FROM (SELECT w.k, r.i, {read} FROM way w JOIN rows r ON r.k = w.k AND r.i = w.i + 1)),
        goal AS (SELECT w.k, least(z0, z3) AS z FROM way w JOIN facts f ON f.k = w.k AND f.n = w.i)
        SELECT DISTINCT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(z.c, 0) AS cost, coalesce(z.a, '') AS audit, sha256(coalesce(array_to_string(z.r, chr(10)), '')) AS repaired_sha256
        FROM drawn d LEFT JOIN facts f ON f.k = d.k LEFT JOIN goal g ON g.k = d.k"""


QUERIES = {"op11_repair": op11_repair}
ORACLE_SQL = {"op11_repair": _oracle()}
