"""Packing of token sequences into windows by minimum bin slack.

Every document becomes its ids and an end id. What fills whole windows is cut off; of the rest only the number of remainders of each
length counts, at most ``capacity - 1`` numbers, whatever the size of the corpus. Over these the driver plans: the greatest
remaining length opens a window, and subset sums of the other lengths, held as the bits of an integer, tell which multiset comes closest to
capacity; the bit sets before each length give its count back. A multiset that fills the window is used as often as the counts
allow. Lengths that no remaining multiset completes are laid end to end and cut at the window ends, which fills these windows too, and the last, partial one is cut
at powers of two, where no padding is due.

Remainders find their place by their rank among those of their length: ranks are counted inside each task and shifted by the counts of the tasks before, so
no length, however common, is gathered in one task.

Defined results: a null text counts as empty and has the end id only; very long texts are read whole, in pieces cut before white space, where tokens never
join; repeated rows and repeated or null ids get pieces for each row; other columns are ignored, whatever their names; an empty table gives no rows. Which of the
remainders of one length goes where depends on how the input is dealt to tasks; the sequences' lengths do not.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import parts
from .common import durable, table

#: Bytes of ASCII white space, bytes before which it surely begins, letters, punctuation. The byte-level pattern ends a token before white space that follows
#: anything else, and before punctuation that follows a letter, so texts may be cut there.
SPACE, SURE, LETTER, MARK = (np.zeros(256, bool) for _ in range(4))
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SURE[[*range(0x21, 0x7F), *range(0x80, 0x100)]] = True
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: The other characters of white space. No cut is made after these, nor after control characters.
WIDE_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
UNSURE = frozenset(map(chr, [*range(0x21), 0x7F])) | frozenset(WIDE_SPACES)
#: Bytes of text that are worked on together, chunks whose ids are remembered, and bytes of new chunks that are encoded in one call.
TOGETHER, REMEMBERED, CALL = 1 << 22, 1 << 19, 1 << 14


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks of the texts that begin at ``starts`` begin, in order: at ASCII white space after a character that is surely not white space, and at
    ASCII punctuation after an ASCII letter."""
    begins = np.zeros(len(data), bool)
    begins[1:] = SPACE[data[1:]] & SURE[data[:-1]] | MARK[data[1:]] & LETTER[data[:-1]]
    wide = np.flatnonzero(begins[1:] & (data[:-1] >= 0x80)) + 1
    for space in WIDE_SPACES:
        raw = np.frombuffer(space.encode(), np.uint8)
        same = wide >= len(raw)
        for k, byte in enumerate(raw):
            same &= data[np.maximum(wide - len(raw) + k, 0)] == byte
        begins[wide[same]] = False
    begins[starts] = True
    return np.flatnonzero(begins)


class Ids:
    """Ids of texts under a byte-level tokenizer. Texts are cut into chunks, of which only those not met lately are encoded, many in one call."""

    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark keeps the cores busy
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(tokenizer)
        self.model.encode_special_tokens = True
        self.sizes = np.zeros(self.model.get_vocab_size(), np.int64)
        for token, number in self.model.get_vocab(with_added_tokens=False).items():
            self.sizes[number] = len(token)  # such a tokenizer spells each byte by one character
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.first, self.count = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Adds the ids of new chunks. Those that begin with white space and end with none are laid end to end, and their ids told apart by their bytes."""
        joint = [c for c in chunks if c[0] in " \t\n\r\v\f" and c[-1] not in UNSURE]
        single = [c for c in chunks if not (c[0] in " \t\n\r\v\f" and c[-1] not in UNSURE)]
        made, counts = [self.pool], []
        sizes = np.fromiter((len(c.encode()) for c in joint), np.int64, len(joint))
        part = (np.cumsum(sizes) - sizes) // CALL
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(joint)] if joint else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            ids = np.array(self.model.encode_batch_fast(["".join(joint[a:b])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(sizes[a:b])) + 1
            made.append(ids)
            counts.append(np.diff(ends, prepend=0))
        for a in range(0, len(single), 1024):
            found = [e.ids for e in self.model.encode_batch_fast(single[a : a + 1024], add_special_tokens=False)]
            made.append(np.array([i for ids in found for i in ids], np.uint32))
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
        self.known |= zip(joint + single, range(len(self.known), len(self.known) + len(chunks)))
        fresh = np.concatenate(counts) if counts else np.empty(0, np.int64)
        self.first = np.concatenate((self.first, len(self.pool) + np.cumsum(fresh) - fresh))
        self.count = np.concatenate((self.count, fresh))
        self.pool = np.concatenate(made)

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's end; nulls are empty."""
        texts = texts.fill_null("").cast(pa.string())
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        if ends[-1] == ends[0]:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends -= ends[0]
        begins = cuts(data, np.unique(ends[:-1][np.diff(ends) > 0]))
        offsets = np.concatenate((begins, ends[-1:])).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.forget()
        words = chunks.dictionary.to_pylist()
        self.learn([w for w in words if w not in self.known])
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[chunks.indices.to_numpy()]
        count = self.count[which]
        upto = np.cumsum(count)
        ids = self.pool[np.repeat(self.first[which] - upto + count, count) + np.arange(upto[-1])]
        return ids, np.concatenate(([0], upto))[np.searchsorted(begins, ends[1:])]


def windows(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Of each document: ``doc_id, doc_tokens``, the checksums of its full windows, its ``rest`` with checksum and ``length``, and the task with the
    full windows (``before``) and the remainders of that length (``rank``) that the task met earlier."""
    schema = T.StructType([
        docs.select(F.col(id_col).alias("doc_id")).schema[0], *[T.StructField(c, T.LongType()) for c in ("doc_tokens", "task", "before", "length", "rank", "rest_crc32")],
        T.StructField("full", T.ArrayType(T.LongType())), T.StructField("rest", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, width = Ids(tokenizer), TaskContext.get().partitionId(), 4 * capacity
        end, before, ranks = np.asarray([end_id], "<u4").tobytes(), 0, [0] * capacity
        for batch in batches:
            for first, count in parts(batch.column(1), TOGETHER):
                found: list[list] = [[] for _ in range(8)]
                flat, ends = encoder.encode(batch.column(1).slice(first, count))
                packed = flat.astype("<u4", copy=False).tobytes()
                for a, b in zip([0, *ends.tolist()], ends.tolist()):
                    ids = packed[4 * a : 4 * b] + end
                    full = [zlib.crc32(ids[a : a + width]) for a in range(0, len(ids) - width + 1, width)]
                    rest = ids[len(full) * width :]
                    length = len(rest) // 4
                    for column, value in zip(found, (len(ids) // 4, task, before, length, ranks[length], zlib.crc32(rest), full, rest)):
                        column.append(value)
                    before += len(full)
                    ranks[length] += 1
                kinds = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.binary()]
                made = [pa.array(c, k) for c, k in zip(found, kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, count), *made], schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, with counts, whose sum comes closest to ``room`` without passing it; greater lengths first."""
    reach, steps = 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((reach, length, take))
            reach |= (reach << length * take) & ((2 << room) - 1)
            left, take = left - take, 2 * take
        if reach >> room & 1:
            break
    total, picked = reach.bit_length() - 1, {}
    for reach, length, take in reversed(steps):
        if not reach >> total & 1:
            total -= length * take
            picked[length] = picked.get(length, 0) + take
    return picked


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """Full windows as ``(times, {length: count})``, and how many of each length no window could be completed with."""
    left, made, tail = {x: n for x, n in counts.items() if n}, [], {}
    while left:
        longest = max(left)
        left[longest] -= 1
        need = fill(left, capacity - longest)
        left[longest] += 1
        need[longest] = need.get(longest, 0) + 1
        if sum(x * n for x, n in need.items()) == capacity:
            times = min(left[x] // n for x, n in need.items())
            made.append((times, need))
            for x, n in need.items():
                left[x] -= n * times
        else:
            tail[longest] = left.pop(longest)
        left = {x: n for x, n in left.items() if n}
    return made, tail


def slots(made: list[tuple[int, dict[int, int]]], tail: dict[int, int]) -> tuple[list[tuple], int, int]:
    """Rows ``length, first, last, need, sequence, place, tail`` for the ranks of each length, the sequences that are full, and the tokens of the tail.

    ``place`` is the offset in a full window, or the place among the tail's tokens.
    """
    used: dict[int, int] = {}
    rows, sequence, place = [], 0, 0
    for times, need in made:
        offset = 0
        for length, n in need.items():
            first = used.get(length, 0)
            rows.append((length, first, first + n * times, n, sequence, offset, False))
            used[length] = first + n * times
            offset += n * length
        sequence += times
    for length, n in tail.items():
        first = used.get(length, 0)
        rows.append((length, first, first + n, 1, sequence, place, True))
        place += n * length
    return rows, sequence, place


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``; ``tokenizer`` is a tokenizer's JSON."""
    spark = docs.sparkSession
    rows = durable(windows(docs, tokenizer, capacity, end_id, id_col, text_col))
    rest = rows.filter("length > 0").groupBy("task", "length").agg(F.count("*").alias("n"))
    whole = rows.groupBy("task").agg(F.sum(F.size("full")).alias("n")).select("task", F.lit(capacity).cast("long").alias("length"), "n")
    seen = durable(rest.unionByName(whole))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = seen.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")

    counts = {r["length"]: r["n"] for r in seen.filter(F.col("length") < capacity).groupBy("length").agg(F.sum("n").alias("n")).collect()}  # under capacity rows
    made, tail = plan(counts, capacity)
    places, sequences, tokens = slots(made, tail)
    edge = tokens // capacity * capacity
    borders, at = [], edge  # where the sequences of the last, partial window begin
    for bit in range(capacity.bit_length(), -1, -1):
        if tokens - edge >> bit & 1:
            borders.append(at)
            at += 1 << bit
    first_full = sequences + edge // capacity + len(borders)

    kept = F.when(F.col("length").isin([*tail, -1]), F.col("rest"))
    loose = rows.filter("length > 0").select("doc_id", "doc_tokens", "task", "length", "rank", "rest_crc32", kept.alias("rest"))
    loose = loose.join(bases, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "task")
    slot = spark.createDataFrame(places, "length long, first long, last long, need long, sequence long, place long, tail boolean").withColumnRenamed("length", "of")
    met = loose.join(F.broadcast(slot), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))  # a few rows a length
    met = met.withColumn("nth", F.col("rank") - F.col("first")).withColumn("from", F.col("doc_tokens") - F.col("length"))
    exact = met.filter("NOT tail").select(
        "doc_id", F.col("from").alias("start"), "length", F.col("rest_crc32").alias("ids_crc32"), "doc_tokens",
        F.expr("sequence + nth div need").alias("sequence_id"), F.expr("place + nth % need * length").alias("offset"),
    )
    pieces = exact.unionByName(_cut(met.filter("tail"), capacity, edge, borders))
    full = rows.filter(F.size("full") > 0).select("doc_id", "doc_tokens", "task", "before", F.posexplode("full").alias("nth", "ids_crc32"))
    of_task = bases.filter(F.col("length") == capacity).select("task", "base")
    full = full.join(of_task, "task").select(
        "doc_id", (F.col("nth") * F.lit(capacity).cast("long")).alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("base") + F.col("before") + F.col("nth") + first_full).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return pieces.unionByName(full)


def _cut(laid: DataFrame, capacity: int, edge: int, borders: list[int]) -> DataFrame:
    """Pieces of the remainders laid end to end: cut at multiples of ``capacity``, and at ``borders`` after ``edge``."""
    at, listed = "(place + nth * length)", f"array({', '.join(f'{b}L' for b in borders)})" if borders else "cast(array() as array<bigint>)"
    inner = f"filter(concat(array(({at} div {capacity} + 1) * {capacity}), {listed}), x -> x > {at} and x < {at} + length)"
    cuts = laid.withColumn("_starts", F.expr(f"array_sort(array_distinct(concat(array({at}), {inner})))"))
    ends = F.expr(f"concat(slice(_starts, 2, size(_starts)), array({at} + length))")
    cuts = cuts.withColumn("_p", F.explode(F.arrays_zip(F.col("_starts").alias("a"), ends.alias("b"))))
    cuts = cuts.withColumn("_skip", F.expr(f"_p.a - {at}")).withColumn("_long", F.expr("_p.b - _p.a")).withColumn("_met", F.expr(f"filter({listed}, x -> x <= _p.a)"))
    last = F.expr(f"_p.a >= {edge}L")
    return cuts.select(
        "doc_id", F.expr("`from` + _skip").alias("start"), F.col("_long").alias("length"),
        F.expr("crc32(substring(rest, int(4 * _skip) + 1, int(4 * _long)))").alias("ids_crc32"), "doc_tokens",
        F.when(last, F.expr(f"sequence + {edge // capacity} + size(_met) - 1")).otherwise(F.expr(f"sequence + _p.a div {capacity}")).alias("sequence_id"),
        F.when(last, F.expr("_p.a - array_max(_met)")).otherwise(F.expr(f"_p.a % {capacity}")).alias("offset"),
    )


def public_tokenizer() -> str:
    """JSON of the public 50k byte-level tokenizer."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1,024 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizer())


QUERIES = {"op12_packing": op12_packing}
ORACLE_SQL: dict[str, str] = {}
