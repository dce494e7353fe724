"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is split by the vocabulary's pattern. Tier one: a minimal perfect hash
over the vocabulary (hash and displace, exactly one slot a token) finds
pre-tokens that are tokens as they are; the bytes in the slot decide. Tier two:
other pre-tokens are merged by a heap of pair ranks over a linked list of
their bytes, least rank first, leftmost of equals. Distinct pre-tokens of a task are
resolved together and remembered up to a bound; documents then join their packed ids.

Defined results: a null text encodes as the empty text; no special tokens
exist, their strings are ordinary text; repeated rows each get a row; an empty table gives no
rows; a vocabulary must hold all 256 bytes.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

REMEMBERED = 1 << 17
PIECE_BYTES = 1 << 20


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    return [token for _, token in ranked]


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: ``len(keys)`` slots for as many keys."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n = len(keys)
        self.buckets = max(1, self.n // 4)
        first, second, step = self._hashes(keys)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, b in enumerate(first.tolist()):
            members[b].append(i)
        self.shift = np.zeros(self.buckets, np.int64)
        owner = np.full(self.n, -1, np.int64)
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = np.array(members[b], np.int64)
            if len(own) < 2:
                break
            for base in range(1, 1 << 22, 512):
                tries = self._place(second[own], step[own], np.arange(base, base + 512)[:, None])
                ordered = np.sort(tries, axis=1)
                fits = np.flatnonzero((owner[tries] < 0).all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
                if len(fits):
                    d, slots = base + int(fits[0]), tries[fits[0]]
                    break
            else:
                raise ValueError("keys are not distinct")
            owner[slots], self.shift[b] = own, d
        empty = iter(np.flatnonzero(owner < 0).tolist())
        for b in range(self.buckets):
            if len(members[b]) == 1:
                slot = next(empty)
                owner[slot], self.shift[b] = members[b][0], -slot - 1
        self.owner = owner

    def _hashes(self, keys: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        wide = [xxhash.xxh3_128_intdigest(k) for k in keys]
        low = np.fromiter((w & 0xFFFFFFFFFFFFFFFF for w in wide), np.uint64, len(wide))
        high = np.fromiter((w >> 64 for w in wide), np.uint64, len(wide))
        return ((low ^ high) % np.uint64(self.buckets)).astype(np.int64), low, high | np.uint64(1)

    def _place(self, low: np.ndarray, odd: np.ndarray, shift: np.ndarray | int) -> np.ndarray:
        mixed = low + np.asarray(shift, np.int64).astype(np.uint64) * odd
        mixed = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return ((mixed >> np.uint64(20)) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The only key each string can be, by its number."""
        first, second, step = self._hashes(keys)
        shift = self.shift[first]
        return self.owner[np.where(shift < 0, -shift - 1, self._place(second, step, shift))]


class ByteBpe:
    """One vocabulary: encoding of pre-tokens and decoding of ids."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.known = PerfectHash(tokens)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.pair_rank = np.full(1 << 16, -1, np.int64)
        for rank in np.flatnonzero(self.sizes == 2).tolist():
            self.pair_rank[int.from_bytes(tokens[rank], "big")] = rank

    def pairs(self, words: list[bytes], bits: int) -> Iterator[list[int]]:
        """Heap entries ``rank, begin, end`` of the adjacent bytes of each word that are a token, packed into integers."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        ends = np.cumsum(size)
        at = np.arange(len(flat) - 1) - np.repeat(ends - size, size)
        rank = self.pair_rank[flat[:-1] << 8 | flat[1:]]
        rank[ends - 1] = -1
        some = np.flatnonzero(rank >= 0)
        whole = np.int64 if 2 * bits + len(self.tokens).bit_length() < 63 else object
        rank, at = rank[some].astype(whole), at[some].astype(whole)
        entries = (rank << 2 * bits | at << bits | at + 2).tolist()
        cuts = np.searchsorted(some, ends).tolist()
        return (entries[a:b] for a, b in zip([0, *cuts], cuts))

    def merge(self, word: bytes, heap: list[int], bits: int) -> list[int]:
        """Ids of a pre-token that is no token itself, from the entries of its adjacent bytes."""
        rank, n = self.ranks.get, len(word)
        low, wide = (1 << bits) - 1, 2 * bits
        heapq.heapify(heap)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        while heap:
            entry = heapq.heappop(heap)
            i, end = entry >> bits & low, entry & low
            j = after[i]
            if j >= n or after[j] != end:
                continue
            after[i], after[j] = end, -1
            before[end] = i
            if end < n and (r := rank(word[i : after[end]])) is not None:
                heapq.heappush(heap, r << wide | i << bits | after[end])
            if (h := before[i]) >= 0 and (r := rank(word[h:end])) is not None:
                heapq.heappush(heap, r << wide | h << bits | end)
        out, i = [], 0
        while i < n:
            out.append(rank(word[i : after[i]]))
            i = after[i]
        return out

    def resolve(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, packed: the perfect hash first, the heap for the rest."""
        found = self.known.slots(words).tolist()
        missed = [w for w, i in zip(words, found) if self.tokens[i] != w]
        bits = max(map(len, missed), default=0).bit_length()
        heaps = self.pairs(missed, bits)
        return [array("i", [i] if self.tokens[i] == w else self.merge(w, next(heaps), bits)).tobytes() for w, i in zip(words, found)]

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.sizes[ids]
        return self.flat[spans(self.offsets[ids], size)].tobytes()


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


class Encoder:
    """Encodes texts; remembers the pre-tokens met lately, some ``2 * REMEMBERED`` of them, with their ids as packed bytes."""

    def __init__(self, model: ByteBpe, pattern: str) -> None:
        self.model, self.split = model, regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        """Ids of pre-tokens that are not remembered, or were before the last time of forgetting."""
        fresh = [w for w in words if w not in self.old]
        self.known |= {w: self.old[w] for w in words if w in self.old}
        self.known |= zip(fresh, self.model.resolve([w.encode("utf-8", "surrogatepass") for w in fresh]))

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's end."""
        if len(self.known) > REMEMBERED:
            self.known, self.old = {}, self.known
        pieces = [self.split(text) for text in texts]
        self.learn(set().union(*pieces).difference(self.known))
        ids_of = self.known.__getitem__
        packed = [b"".join(map(ids_of, row)) for row in pieces]
        return np.frombuffer(b"".join(packed), np.int32), np.cumsum([len(p) // 4 for p in packed], dtype=np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, ends = self.encode_flat(texts)
        return np.split(ids, ends[:-1]) if len(texts) else []


def parts(texts: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """First row and row count of consecutive texts of about ``size`` bytes together."""
    bytes_of = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(bytes_of, dtype=np.int64) - bytes_of) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return ((a, b - a) for a, b in zip(cuts[:-1], cuts[1:]) if b > a)


def encode(text: Column, model: ByteBpe, pattern: str) -> Column:
    """``array<int>`` of ids."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(model, pattern)
        for texts in batches:
            cut = parts(pa.array(texts, pa.string(), from_pandas=True))
            yield pd.Series([ids for a, n in cut for ids in encoder.encode([t or "" for t in texts.iloc[a : a + n]])], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<int>")(text)


def decode(ids: Column, model: ByteBpe) -> Column:
    """The bytes of ``array<int>`` ids; null ids decode as none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([b"" if r is None else model.decode(np.asarray(r, np.int64)) for r in rows], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "binary")(ids)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``, the bytes of the ids, in place of columns so named.

    Both are made in one pass, a part of an Arrow batch at a time.
    """
    model = ByteBpe(read_ranks(ranks_path))
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    made = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, pattern)
        for batch in batches:
            texts = batch.column(len(kept))
            for first, count in parts(texts):
                ids, ends = encoder.encode_flat([t or "" for t in texts.slice(first, count).to_pylist()])
                sizes = np.concatenate(([0], np.cumsum(model.sizes[ids], dtype=np.int64)))
                at = np.concatenate(([0], ends))
                decoded = pa.BinaryArray.from_buffers(pa.binary(), count, [None, pa.py_buffer(sizes[at].astype(np.int32)), pa.py_buffer(model.decode(ids))])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
                own = [c.slice(first, count) for c in batch.columns[: len(kept)]]
                yield pa.RecordBatch.from_arrays([*own, lists, decoded], [*kept, "ids", "decoded"])

    rows = docs.select(*kept, F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, T.StructType([*docs.select(*kept).schema.fields, *made.fields]))


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    found = round_trip(docs.select("doc_id", "text"), ranks_path, pattern)
    spelt = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(spelt, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def public_vocabulary() -> tuple[str, str]:
    """Path and pattern of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the round trip of all documents."""
    return token_digests(table(spark, sf_dir, "documents"), *public_vocabulary())


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
