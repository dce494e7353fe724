"""Near copies by shingle similarity: Jaccard similarity of word shingle sets, checked exactly.

Candidates share one of ``BANDS`` bands of ``DEPTH`` MinHash values; a pair of similarity 0.8 shares none with probability
``(1 - 0.8**4)**32``, 5e-8, a more similar pair with less. All pairs of a band's bucket are then compared by their whole
sets. The members of a bucket of over ``tile`` are first compared with its least member, once for all buckets with that least
member. Where that leaves a bucket in several components, only members of different components meet: those of small components meet all
others, tile by tile, large components each other, none itself. So a large group of copies costs no square.

Links join SimHash values, the nodes of ``simhash.near_duplicates``: rows with equal SimHash are one already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_table, durable, maybe_in
from .components import connected_components
from .simhash import LOWER_TABLE, SEED, simhash

BANDS, DEPTH = 32, 4
BLOCK = 1 << 12
_rng = np.random.default_rng(5)
MASKS, ODDS = _rng.integers(0, 1 << 63, (2, BANDS * DEPTH, 1), np.uint64)
ODDS |= np.uint64(1)
NODE = "fp long, sid long"


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's ``width``-word shingles; of a shorter text, of all its words."""
    words = [w for w in (text or "").encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split(b" ") if w]
    found = {xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(max(1, len(words) - width + 1))} if words else ()
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A hash of each band of MinHash values, as signed longs; none of an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, ((hashes[at : at + BLOCK] ^ MASKS) * ODDS).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, DEPTH))], np.uint64).view(np.int64)


def with_bands(docs: DataFrame, text_col: str, simhash_width: int, width: int) -> DataFrame:
    """Adds ``fp``, the SimHash, ``sid``, the id of the shingle set, and its ``bands``."""

    def mark(text: str | None) -> tuple[int, int, np.ndarray]:
        hashes = shingles(text, width)
        return simhash(text, simhash_width), set_id(hashes), bands(hashes)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            fps, sids, found = zip(*map(mark, texts)) if len(texts) else ((), (), ())
            yield pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64), "sid": np.array(sids, np.uint64).view(np.int64), "bands": list(found)})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    once = F.pandas_udf(run, f"{NODE}, bands array<long>").asNondeterministic()  # else each use runs it again
    return docs.withColumn("_made", once(F.col(text_col))).select(*docs.columns, "_made.fp", "_made.sid", "_made.bands")


def whole_sets(texts: DataFrame, simhash_width: int, width: int, rows: int = 128) -> DataFrame:
    """``fp, sid, shingles`` of the one column of ``texts``, a few rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.column(0).slice(at, rows).to_pylist()
                sets = [shingles(t, width) for t in part]
                fps = np.fromiter((simhash(t, simhash_width) for t in part), np.uint64, len(part)).view(np.int64)
                sids = np.fromiter(map(set_id, sets), np.uint64, len(sets)).view(np.int64)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array(sids), held], names=["fp", "sid", "shingles"])

    return texts.mapInArrow(run, f"{NODE}, shingles array<long>")


def similar_forest(fps: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links of sets with similarity ``least`` or more that span all such links; equal ``fps`` are one node."""
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    part = np.unique(np.array(fps), return_inverse=True)[1].ravel()
    held = np.zeros(int(flat.max()) + 1, bool)
    out = []
    for i in range(len(sets)):
        if (part == part[0]).all():
            break
        if (part[i:] == part[i]).all():
            continue
        mine = flat[begin[i] : begin[i] + sizes[i]]
        held[mine] = True
        shared = np.add.reduceat(held[flat[begin[i] :]], begin[i:] - begin[i], dtype=np.int64)
        held[mine] = False
        near = shared >= least * (sizes[i] + sizes[i:] - shared) - 1e-9
        for j in (np.flatnonzero(near) + i).tolist():
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                out.append((fps[i], fps[j]))
    return out


def compared(lists: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Edges ``a, b`` inside the lists ``members`` of ``fp, sid``; equal lists are compared once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fps, sets = None, [], []
        for batch in batches:
            out = []
            held = batch.column("shingles")
            values, ends = held.values.to_numpy(), held.offsets.to_numpy()
            for k, (number, fp) in enumerate(zip(batch.column("list").to_pylist(), batch.column("fp").to_pylist())):
                if number != now:
                    out += similar_forest(fps, sets, least) if len(fps) > 1 else []
                    now, fps, sets = number, [], []
                fps.append(fp)
                sets.append(values[ends[k] : ends[k + 1]])
            sets = [x.copy() for x in sets]  # the batch goes
            yield edges_of(out)
        yield edges_of(similar_forest(fps, sets, least) if len(fps) > 1 else [])

    rows = lists.select(F.array_sort(F.array_distinct("members")).alias("members")).distinct()
    rows = rows.select(F.xxhash64("members").alias("list"), F.explode("members").alias("m")).select("list", "m.fp", "m.sid")
    full = rows.join(sets, ["fp", "sid"]).select("list", "fp", "shingles").repartition("list").sortWithinPartitions("list")
    return full.mapInArrow(run, "a long, b long")


def edges_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])


def similar_links(docs: DataFrame, marked: DataFrame, known: DataFrame, simhash_width: int, width: int, least: float, tile: int = 256) -> DataFrame:
    """Edges that connect what the edges ``known`` and those between SimHash values of texts with similarity ``least`` or more connect.

    ``docs`` has ``doc_id, _text``, ``marked`` their ``doc_id, fp, sid, bands``; it should be durable.
    """
    nodes = marked.groupBy("fp", "sid").agg(F.first("bands").alias("bands"))
    placed = nodes.select("fp", "sid", F.explode("bands").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"), F.min(F.struct("fp", "sid")).alias("pivot"))
    members = durable(placed.join(sizes.filter("low != high").drop("low", "high"), "bucket"))
    asked = members.select("fp", "sid").distinct()
    ids = durable(marked.join(asked, ["fp", "sid"], "left_semi").select(F.xxhash64("doc_id").alias("_id")).distinct())
    picked = maybe_in(docs.withColumn("_id", F.xxhash64("doc_id")), "_id", *bit_table(ids, "_id", ids.count())).select("_text")
    sets = whole_sets(picked, simhash_width, width).join(asked, ["fp", "sid"], "left_semi")
    sets = durable(sets.groupBy("fp", "sid").agg(F.first("shingles").alias("shingles")))
    node = F.struct("fp", "sid")
    few = members.filter(F.col("n") <= tile).groupBy("bucket").agg(F.collect_list(node).alias("members")).select("members")
    large = members.filter(F.col("n") > tile)
    pairs = large.select("pivot", node.alias("member")).distinct()  # a group of copies has few least members for all its buckets
    salts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / tile).alias("salts"))
    stars = pairs.join(salts, "pivot").groupBy("pivot", F.pmod(F.xxhash64("member"), F.col("salts")).alias("salt")).agg(F.collect_list("member").alias("members"))
    stars = stars.select(F.concat("members", F.array("pivot")).alias("members"))
    edges = durable(compared(few.unionByName(stars), sets, least).unionByName(known).distinct())
    if large.isEmpty():
        return edges
    roots = connected_components(edges)
    contracted = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))  # connects as edges do, in one step
    return contracted.unionByName(compared(across_components(large, roots, tile), sets, least))


def across_components(large: DataFrame, roots: DataFrame, tile: int) -> DataFrame:
    """Lists ``members`` that hold, for every bucket of ``large``, all pairs of members of different components."""
    node = F.struct("fp", "sid")
    placed = large.select("bucket", "fp", "sid").join(roots, F.col("fp") == F.col("node"), "left").select("bucket", "fp", "sid", F.coalesce("root", "fp").alias("root"))
    several = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("bucket")
    placed = durable(placed.join(several, "bucket"))
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("size")).withColumn("own", F.when(F.col("size") >= tile, F.col("root")))
    tiles = sizes.groupBy(F.col("bucket").alias("of"), F.col("own").alias("of_own")).agg(F.ceil(F.sum("size") / tile).alias("tiles"))
    dealt = sizes.join(tiles, (F.col("bucket") == F.col("of")) & F.col("own").eqNullSafe(F.col("of_own"))).select("bucket", "root", "own", "tiles")
    pieces = placed.join(dealt, ["bucket", "root"]).withColumn("piece", F.pmod(F.xxhash64("fp", "sid"), F.col("tiles")))
    pieces = durable(pieces.groupBy("bucket", "own", "piece").agg(F.collect_list(node).alias("members")))
    mixed = pieces.filter("own is null").select("bucket", F.col("piece").alias("mixed"), F.col("members").alias("others"))
    met = mixed.join(pieces, "bucket").filter("own is not null or piece >= mixed")  # a piece with itself, too
    owners = pieces.filter("own is not null").select("bucket", "own").distinct()
    apart = owners.join(owners.withColumnRenamed("own", "own2"), "bucket").filter("own < own2")
    one = pieces.select("bucket", "own", F.col("members").alias("others"))
    two = pieces.select("bucket", F.col("own").alias("own2"), "members")
    big = apart.join(one, ["bucket", "own"]).join(two, ["bucket", "own2"])
    return met.select(F.concat("others", "members").alias("members")).unionByName(big.select(F.concat("others", "members").alias("members")))
