"""Removal of repeated byte passages by prefix-free parsing and suffix order.

A passage is a string of ``length`` bytes (50). It is removed wherever it
starts in a document if it also starts in a document with a smaller id;
overlaps count and matches never cross documents.

1. *Parse.* A rolling hash of ``gram`` bytes triggers phrase breaks: the
   trigger of a passage is its gram of least hash, the leftmost of equals, so
   equal passages have equal triggers at equal offsets. Successive passages of one trigger
   make a phrase; phrases overlap, and every passage lies whole in one phrase.
2. *Filter.* Only phrases whose trigger occurs in another document can hold a
   repeated passage. Blocks of documents send the hashes of their distinct
   triggers, in packed arrays dealt by hash range, and get back which ones repeat.
   A trigger in too many different phrases (a common line in ever new surroundings) comes back as
   hot: each of its passages then is a phrase of its own, whose trigger is the
   whole passage, and is filtered in the same way. So no group grows with the phrases of one trigger.
3. *Dictionary and parse.* Blocks send the distinct phrases of repeated triggers, each with
   the least document of the block that holds it. Phrases meet by trigger:
   equal ones collapse (the dictionary) and keep the least document of all (the parse).
4. *Corpus order.* The suffixes of the dictionary are sorted to ``length``
   bytes by 8-byte words, each round on the ties of the last. Suffixes equal
   to that depth take the least document of their phrases.
5. Blocks get those documents back and remove what a smaller document has.

Text is dealt to blocks once; a passage that very many documents share reaches
a task once a block, not once a document. All comparisons are on bytes; hashes only
choose where to look.

Defined results: a null text counts as empty; a very long text is one document of one block; documents with equal ids are not smaller
than each other; rows repeated with equal id and text are worked out once and get a row each; a null id is greater than any
other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

GRAM = 24
MANY = 8
STRIDE = 1 << 17
LAST = np.iinfo(np.int64).max
BYTE_HASH = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
FACTOR = 0x9E3779B97F4A7C15
MIXER = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A mixed 64-bit polynomial hash of every ``gram`` bytes, put together from pieces of 1, 2, 4, ... bytes."""
    h, step, factor = BYTE_HASH[data], 1, FACTOR
    out, done, n = np.zeros(len(data), np.uint64), 0, len(data) - gram + 1
    while True:
        if gram & step:
            out = out[:n] * np.uint64(factor) + h[done : done + n]
            done += step
        if step * 2 > gram:
            break
        h = h[:-step] * np.uint64(factor) + h[step:]
        step, factor = step * 2, factor * factor % (1 << 64)
    out ^= out >> np.uint64(32)
    out *= MIXER
    return out ^ (out >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def triggers(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Position and hash of the trigger of the passage at every start of ``data``.

    Triggers are least hashes and so crowd at small values; mixed once more (one to one), they fill all hash ranges alike.
    """
    h = gram_hashes(data, gram)
    packed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    spot = (sliding_min(packed, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    even = (h ^ (h >> np.uint64(31))) * MIXER
    return spot, (even ^ (even >> np.uint64(32)))[spot]


class Block:
    """The documents of one block, laid end to end, and their phrases."""

    def __init__(self, pdf: pd.DataFrame, length: int) -> None:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]
        ids = pd.array(pdf["doc_id"], dtype="Int64")
        order = sorted(range(len(raw)), key=lambda i: (ids[i] is pd.NA, 0 if ids[i] is pd.NA else ids[i], raw[i]))
        self.ids = [ids[i] for i in order]
        self.raw = [raw[i] for i in order]
        self.copies = pdf["copies"].to_numpy()[order].tolist() if "copies" in pdf else [1] * len(raw)
        self.rank = np.array([LAST if i is pd.NA else i for i in self.ids], np.int64)
        self.sizes = np.array([len(r) for r in self.raw], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.data = np.frombuffer(b"".join(self.raw), np.uint8)
        self.length, self.known = length, None
        parts = [self._runs(at) for at in range(0, len(self.data) - length + 1, STRIDE)]
        empty = [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)]
        self.first, self.last, self.owner, self.hashes = (np.concatenate(x) for x in zip(*parts)) if parts else empty

    def _runs(self, at: int) -> tuple[np.ndarray, ...]:
        """First and last start, document and hash of each run of passages with one trigger, of ``STRIDE`` starts."""
        spot, h = triggers(self.data[at : at + STRIDE + self.length - 1], self.length)
        starts = np.arange(at, at + len(spot))
        low, high = np.searchsorted(self.ends, [at, at + len(spot) - 1], side="right").tolist()
        here = np.arange(low, high + 1)  # the documents of these starts, each repeated for its own: no search a byte
        count = np.diff(np.minimum(self.ends[here], at + len(spot)), prepend=at)
        owner, inside = np.repeat(here, count), starts + self.length <= np.repeat(self.ends[here], count)
        spot, h, owner, starts = spot[inside], h[inside], owner[inside], starts[inside]
        new = np.ones(len(spot), bool)
        new[1:] = (spot[1:] != spot[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(spot)) - 1 if len(first) else first
        return starts[first], starts[last], owner[first], h[first]

    def distinct_triggers(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct trigger hashes, and which of them several documents of the block hold; worked out once for the same phrases."""
        if self.known is not None and self.known[0] is self.hashes:
            return self.known[1:]
        order = np.lexsort((self.rank[self.owner], self.hashes))
        h, doc = self.hashes[order], self.rank[self.owner][order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(new)
        shared = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at) if len(at) else np.empty(0, bool)
        self.known = (self.hashes, h[at], shared)
        return h[at], shared

    def phrase_counts(self, triggers: np.ndarray, many: int) -> np.ndarray:
        """Number of different phrases of each of the sorted distinct ``triggers``, or 0 if there are fewer than ``many``."""
        at = np.searchsorted(triggers, self.hashes)
        often = np.flatnonzero((np.bincount(at, minlength=len(triggers)) >= many)[at])
        first, last = self.first[often].tolist(), (self.last[often] + self.length).tolist()
        marks = np.fromiter((xxhash.xxh3_64_intdigest(self.data[a:b]) for a, b in zip(first, last)), np.uint64, len(often))
        found = np.bincount(np.unique(np.stack([at[often].astype(np.uint64), marks]), axis=1)[0].astype(np.int64), minlength=len(triggers))
        return np.where(found >= many, found, 0)

    def split(self, hot: np.ndarray) -> None:
        """Makes every passage of a ``hot`` trigger a phrase of its own, with the hash of the passage; the others are left out until :meth:`unite`."""
        gone = among(self.hashes, np.sort(hot))
        runs, self.cold = np.flatnonzero(gone), tuple(x[~gone] for x in (self.first, self.last, self.owner, self.hashes))
        count = self.last[runs] - self.first[runs] + 1
        starts = ranges_of(self.first[runs], count)
        digest, n = xxhash.xxh3_64_intdigest, self.length
        hashes = np.fromiter((digest(self.data[a : a + n]) for a in starts.tolist()), np.uint64, len(starts))
        self.first, self.last, self.owner, self.hashes = starts, starts, np.repeat(self.owner[runs], count), hashes

    def unite(self) -> None:
        own = (self.first, self.last, self.owner, self.hashes)
        self.first, self.last, self.owner, self.hashes = (np.concatenate(x) for x in zip(self.cold, own))

    def phrases(self, repeated: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct phrases of repeated triggers in order of hash, then of their first run.

        Also their hashes, their least document, and for every occurrence its run and its phrase. Equal bytes have equal hashes.
        """
        runs = np.flatnonzero(among(self.hashes, np.sort(repeated)))
        whole, number = self.data.tobytes(), {}
        first, last = self.first[runs].tolist(), (self.last[runs] + self.length).tolist()
        met = np.fromiter((number.setdefault(whole[a:b], len(number)) for a, b in zip(first, last)), np.int64, len(runs))
        hashes = np.empty(len(number), np.uint64)
        hashes[met[::-1]] = self.hashes[runs][::-1]
        order = np.argsort(hashes, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        which, found = place[met], list(number)
        least = np.full(len(order), LAST, np.int64)
        np.minimum.at(least, which, self.rank[self.owner[runs]])
        return [found[i] for i in order.tolist()], hashes[order], least, runs, which


def hash_range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each hash by its high half; rises with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def range_slices(hashes: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """``(range, from, to)`` of the filled ranges of sorted ``hashes``."""
    dealt = hash_range(hashes, ranges)
    at = np.flatnonzero(np.diff(dealt, prepend=-1)).tolist()
    return [(int(dealt[a]), a, b) for a, b in zip(at, at[1:] + [len(dealt)])]


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values the sorted array ``known`` holds."""
    at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
    return known[at] == values if len(known) else np.zeros(len(values), bool)


KEYS = "block long, part long, keys binary, shared binary, counts binary"
FOUND = "doc_id long, copies long, n_bytes long, span_starts array<long>, span_ends array<long>, kept binary"
TOLD = "block long, part long, flags binary, hot binary, again binary, found binary"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names(schema))


def send_triggers(ranges: int, length: int, many: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = Block(pdf, length)
        return frame(packed_triggers(block, int(pdf["block"].iloc[0]), ranges, many), KEYS)

    return run


def packed_triggers(block: Block, number: int, ranges: int, many: int | None) -> list[tuple]:
    """Rows of the block's distinct triggers by hash range; with ``many``, also the places and numbers of those in as many phrases."""
    h, shared = block.distinct_triggers()
    low, count = h.astype(np.uint32), block.phrase_counts(h, many) if many else np.zeros(len(h), np.int64)
    rows = []
    for r, a, b in range_slices(h, ranges):
        at = np.flatnonzero(count[a:b])
        rows.append((number, r, low[a:b].tobytes(), shared[a:b].tobytes(), np.stack([at, count[a:b][at]]).astype(np.int32).tobytes()))
    return rows


def repeated_triggers(most: int):
    """Which trigger hashes of each block other blocks hold too, or several of its documents; and which have over ``most`` phrases."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, np.uint32) for k in pdf["keys"]]
        counts = [np.frombuffer(c, np.int32).reshape(2, -1) for c in pdf["counts"]]
        ordered = np.sort(np.concatenate(keys))
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        often, at = np.unique(np.concatenate([k[c[0]] for k, c in zip(keys, counts)]), return_inverse=True)
        hot = often[np.bincount(at, np.concatenate([c[1] for c in counts]), len(often)) > most]
        rows = []
        for block, part, mine, shared in zip(pdf["block"], pdf["part"], keys, pdf["shared"]):
            flags, burning = among(mine, twice) | np.frombuffer(shared, bool), among(mine, hot)
            if flags.any() or burning.any():
                rows.append((block, part, np.packbits(flags).tobytes(), np.packbits(burning).tobytes() if burning.any() else b"", b"", b""))
        return frame(rows, TOLD)

    return run


def send_passages(ranges: int, length: int):
    """The passages of a block's hot triggers, as triggers of their own."""

    def run(texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told = told[told["hot"].map(len) > 0]
        if not len(texts) or not len(told):
            return frame([], KEYS)
        block = Block(texts, length)
        block.split(flagged(block, told, ranges, "hot"))
        return frame(packed_triggers(block, int(texts["block"].iloc[0]), ranges, None), KEYS)

    return run


def repeated_passages(pdf: pd.DataFrame) -> pd.DataFrame:
    """:func:`repeated_triggers` of passages."""
    found = repeated_triggers(LAST)(pdf)
    return found.assign(again=found["flags"], flags=b"")


def flagged(block: Block, told: pd.DataFrame, ranges: int, name: str) -> np.ndarray:
    """The block's trigger hashes whose bit is set in column ``name`` of what came back."""
    h, _ = block.distinct_triggers()
    spans = {r: (a, b) for r, a, b in range_slices(h, ranges)}
    out = [np.empty(0, np.uint64)]
    for part, flags in zip(told["part"], told[name]):
        if len(flags):
            a, b = spans[part]
            out.append(h[a:b][np.unpackbits(np.frombuffer(flags, np.uint8))[: b - a].astype(bool)])
    return np.concatenate(out)


def told_repeats(block: Block, told: pd.DataFrame, ranges: int) -> np.ndarray:
    """The hashes of the block's phrases that may repeat, from what came back; the passages of hot triggers become phrases."""
    repeated, hot = flagged(block, told, ranges, "flags"), flagged(block, told, ranges, "hot")
    if len(hot):
        block.split(hot)
        repeated = np.concatenate([np.setdiff1d(repeated, hot), flagged(block, told, ranges, "again")])
        block.unite()
    return repeated


def send_phrases(ranges: int, length: int):
    def run(texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        columns = ["block", "part", "bytes", "sizes", "least"]
        if not len(texts) or not len(told):
            return pd.DataFrame([], columns=columns)
        block = Block(texts, length)
        phrases, h, least, _, _ = block.phrases(told_repeats(block, told, ranges))
        sizes = np.array([len(p) for p in phrases], np.int32)
        number = int(texts["block"].iloc[0])
        rows = [(number, r, b"".join(phrases[a:b]), sizes[a:b].tobytes(), least[a:b].tobytes()) for r, a, b in range_slices(h, ranges)]
        return pd.DataFrame(rows, columns=columns)

    return run


def equal_suffixes(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that others equal to ``length`` bytes: their indexes in ``starts``, in suffix order, and their class.

    ``length`` is at least 8. Every round sorts what is still tied by its next eight bytes.
    """
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    tied, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for at in [*range(0, length - 8, 8), length - 8]:
        word = np.ascontiguousarray(words[starts[tied] + at]).view(">u8").ravel().astype(np.uint64)
        order = np.argsort(word) if at == 0 else np.lexsort((word, group))
        tied, group, word = tied[order], group[order], word[order]
        new = np.ones(len(tied), bool)
        new[1:] = (group[1:] != group[:-1]) | (word[1:] != word[:-1])
        group = np.cumsum(new) - 1
        many = (np.bincount(group, minlength=1) > 1)[group] if len(group) else new
        tied, group = tied[many], group[many]
    return tied, group


def ranges_of(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``first[i] .. first[i] + count[i] - 1`` of all ``i`` in a row."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def combine(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dictionary: dict[bytes, int] = {}
        entries, least = [], []
        for raw, sizes, docs in zip(pdf["bytes"], pdf["sizes"], pdf["least"]):
            ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
            entries.append(np.array([dictionary.setdefault(raw[a:b], len(dictionary)) for a, b in zip([0, *ends], ends)], np.int64))
            least.append(np.frombuffer(docs, np.int64))
        entry, mine = np.concatenate(entries), np.concatenate(least)
        parse = np.full(len(dictionary), LAST, np.int64)
        np.minimum.at(parse, entry, mine)
        sizes = np.fromiter(map(len, dictionary), np.int64, len(dictionary))
        offset, count = np.cumsum(sizes) - sizes, sizes - length + 1
        starts = ranges_of(offset, count)
        doc = np.repeat(parse, count)
        tied, group = equal_suffixes(np.frombuffer(b"".join(dictionary), np.uint8), starts, length)
        if len(tied):
            at = np.flatnonzero(np.diff(group, prepend=-1))
            doc[tied] = np.repeat(np.minimum.reduceat(doc[tied], at), np.diff(np.append(at, len(tied))))
        head = np.cumsum(count) - count
        rows, done = [], 0
        for block, part, own, docs in zip(pdf["block"], pdf["part"], entries, least):
            told = doc[ranges_of(head[own], count[own])]
            phrase = np.repeat(np.arange(len(own)), count[own])
            new = np.ones(len(told), bool)
            new[1:] = (told[1:] != told[:-1]) | (phrase[1:] != phrase[:-1])
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(told)))
            skip = at - (np.cumsum(count[own]) - count[own])[phrase[at]]
            worth = told[at] < docs[phrase[at]]
            if worth.any():
                found = np.stack([phrase[at], skip, size, told[at]])[:, worth]
                rows.append((block, part, b"", b"", b"", found.tobytes()))
        return frame(rows, TOLD)

    return run


def remove(ranges: int, length: int):
    def run(texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return frame([], FOUND)
        block = Block(texts, length)
        cover = np.zeros(len(block.data) + 1, np.int32)
        marks = told[told["found"].map(len) == 0]
        if len(marks):
            phrases, h, least, runs, which = block.phrases(told_repeats(block, marks, ranges))
            count = np.array([len(p) - length + 1 for p in phrases], np.int64)
            head = np.cumsum(count) - count
            doc = np.repeat(least, count)
            spans = {r: a for r, a, _ in range_slices(h, ranges)}
            for part, found in zip(told["part"], told["found"]):
                if len(found):
                    phrase, skip, size, value = np.frombuffer(found, np.int64).reshape(4, -1)
                    at = head[phrase + spans[part]] + skip
                    doc[ranges_of(at, size)] = np.repeat(value, size)
            starts = ranges_of(block.first[runs], count[which])
            known = doc[ranges_of(head[which], count[which])]
            gone = starts[known < np.repeat(block.rank[block.owner[runs]], count[which])]
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + length, -1)
        covered = np.cumsum(cover, dtype=np.int32)[:-1] > 0
        rows = []
        for doc_id, copies, raw, end in zip(block.ids, block.copies, block.raw, block.ends.tolist()):
            mine = covered[end - len(raw) : end]
            edges = np.flatnonzero(np.diff(mine, prepend=False, append=False))
            kept = np.frombuffer(raw, np.uint8)[~mine].tobytes() if len(edges) else raw
            rows.append((doc_id, copies, len(raw), edges[::2], edges[1::2], kept))
        out = frame(rows, FOUND)
        return out.assign(doc_id=out["doc_id"].astype("Int64"))

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, block_bytes: int = 1 << 22, range_bytes: int = 1 << 20,
    hot_phrases: int = 1 << 12, many: int = MANY,
) -> DataFrame:
    """Per row: ``doc_id, n_bytes, span_starts, span_ends, kept``: what goes, as byte spans, and the bytes that stay.

    ``block_bytes``: text to a block of documents. ``range_bytes``: text whose
    triggers meet in one hash range. ``length`` is above ``GRAM``. A trigger is hot that has over ``hot_phrases`` phrases in
    the blocks where it has ``many`` or more.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(1).cast("long").alias("copies"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    again = rows.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_again"))
    repeated = not again.isEmpty()
    if repeated:
        same = F.col("doc_id").eqNullSafe(F.col("_again"))
        once = rows.join(again, same, "left_semi").groupBy("doc_id", "text").agg(F.sum("copies").alias("copies"))
        rows = rows.join(again, same, "left_anti").unionByName(once)
    blocks, ranges = max(1, total // block_bytes), max(1, total // range_bytes)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    by_block = dealt.groupBy("block")
    marks = by_block.applyInPandas(send_triggers(ranges, length, many), KEYS).groupBy("part").applyInPandas(repeated_triggers(hot_phrases), TOLD)
    passages = by_block.cogroup(marks.groupBy("block")).applyInPandas(send_passages(ranges, length), KEYS)
    marks = marks.unionByName(passages.groupBy("part").applyInPandas(repeated_passages, TOLD))
    sent = by_block.cogroup(marks.groupBy("block")).applyInPandas(send_phrases(ranges, length), "block long, part long, bytes binary, sizes binary, least binary")
    answers = sent.groupBy("part").applyInPandas(combine(length), TOLD)
    found = by_block.cogroup(marks.unionByName(answers).groupBy("block")).applyInPandas(remove(ranges, length), FOUND)
    out = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))) if repeated else found
    return out.drop("copies", "_copy")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50-byte passages of all documents that a document with a smaller id has."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
