"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are made in vectorised batches: words and shingles are cut on the
UTF-8 bytes, each shingle's XXH64 is taken, and per-bit votes are counted.
Equal fingerprints collapse to one row first. Two fingerprints within
``radius`` bits agree on at least three of ``radius + 3`` bit blocks, so the
distinct ones meet in tiles that share a band, which is any three blocks: some 38 bits for the radius 2, so that a band's members
are few where the corpus is large. A tile holds at most ``tile``
fingerprints: a larger band is cut by bit count, and by hash within a bit count, and its tiles are
compared pairwise, skipping pairs whose bit counts differ by more than the
radius. In a tile numpy compares all with exclusive-or and bit counts, but
only a spanning forest of the links leaves it.

Defined results: a null text counts as empty, with fingerprint zero, and
links like any other; very long texts are read whole; repeated rows keep their row each in :func:`near_duplicates`, while
:func:`keep_representatives` keeps one; null ids never name
a component unless all ids of it are null; other columns are ignored, or kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, lookup, packed, table
from .components import connected_components

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LOWER[WHITE] = 0x20
LOWER_TABLE = LOWER.tobytes()
SEED = 42
VOTE_BLOCK = 1 << 14


def majority(hashes: np.ndarray) -> int:
    """The 64-bit word whose bits are set in over half of ``hashes``."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), VOTE_BLOCK):
        bits = np.unpackbits(hashes[at : at + VOTE_BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def simhash(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's ``width``-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    if len(words) <= width:
        return majority(np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(starts))
    return majority(hashes)


def with_simhash(docs: DataFrame, text_col: str = "text", width: int = 3, name: str = "fp") -> DataFrame:
    """Adds the SimHash as a signed long."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            made = np.fromiter((simhash(t, width) for t in texts), np.uint64, len(texts))
            yield pd.Series(made.view(np.int64))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(name, F.pandas_udf(run, "long")(F.col(text_col)))


def band_masks(radius: int) -> list[int]:
    """The bits of every band, as signed longs: any three of ``radius + 3`` near-equal blocks."""
    edges = [round(64 * i / (radius + 3)) for i in range(radius + 4)]
    blocks = [(1 << high) - (1 << low) for low, high in pairwise(edges)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(chosen) for chosen in combinations(blocks, 3))]


def links(fingerprints: DataFrame, radius: int = 2, tile: int = 2048) -> DataFrame:
    """Edges ``a, b`` that span, per component, all pairs of distinct ``fp`` within ``radius`` bits."""
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(mask)).alias("value")) for i, mask in enumerate(band_masks(radius))])
    placed = fingerprints.select("fp", F.bit_count("fp").alias("pc"), F.explode(bands).alias("k")).select("fp", "pc", "k.band", "k.value")
    key = ["band", "value"]
    sizes = placed.groupBy(*key).agg(F.count("*").alias("members")).filter("members > 1")
    members = placed.join(sizes, key)
    few = members.filter(F.col("members") <= tile).groupBy(*key).agg(F.collect_list("fp").alias("left"))
    few = few.select("left", F.array().cast("array<long>").alias("right"))
    many = members.filter(F.col("members") > tile)
    cuts = many.groupBy(*key, "pc").agg(F.count("*").alias("n"))
    cuts = cuts.select(*key, "pc", F.ceil(F.col("n") / tile).cast("int").alias("pieces"))
    piece = many.join(cuts, [*key, "pc"]).withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    tiles = piece.groupBy(*key, "pc", "piece").agg(F.collect_list("fp").alias("fps"))
    other = tiles.select(*key, F.col("pc").alias("pc2"), F.col("piece").alias("piece2"), F.col("fps").alias("right"))
    near = other.withColumn("pc", F.explode(F.sequence(F.col("pc2") - radius, F.col("pc2"))))
    pairs = tiles.join(near, [*key, "pc"]).filter("pc < pc2 or piece <= piece2")
    right = F.when((F.col("pc") == F.col("pc2")) & (F.col("piece") == F.col("piece2")), F.array().cast("array<long>")).otherwise(F.col("right"))
    wide = pairs.select(F.col("fps").alias("left"), right.alias("right"))
    return few.unionByName(wide).mapInPandas(_tile_comparer(radius), "a long, b long")


def _tile_comparer(radius: int):
    def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the links inside ``left``, or between ``left`` and ``right``."""
        if len(right) == 0 and len(left) == 2:
            near = int(left[0] ^ left[1]).bit_count() <= radius
            return (left[:1], left[1:]) if near else (left[:0], left[:0])
        nodes = np.concatenate((left, right)) if len(right) else left
        root = np.arange(len(nodes))
        keep_a, keep_b = [], []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, value in enumerate(left.tolist()):
            against = right if len(right) else left[i + 1 :]
            shift = len(left) if len(right) else i + 1
            hits = np.flatnonzero(np.bitwise_count(against ^ np.uint64(value)) <= radius) + shift
            for j in hits.tolist():
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    keep_a.append(i)
                    keep_b.append(j)
        return nodes[keep_a], nodes[keep_b]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for left, right in zip(pdf["left"], pdf["right"]):
                found = forest(np.asarray(left, np.int64).view(np.uint64), np.asarray(right, np.int64).view(np.uint64))
                a.append(found[0])
                b.append(found[1])
            yield pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    return run


def grouped_fingerprints(texts: DataFrame, width: int, radius: int, tile: int, similar: tuple[int, float] | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``doc_id, _text``: all rows' ``doc_id, fp``; each ``fp`` with its ``root``, ``least`` id and ``rows``; each root with its ``component_id``."""
    if similar:
        from . import near_copies

        marked = durable(near_copies.with_bands(texts, "_text", width, similar[0]).drop("_text"))
    else:
        marked = durable(with_simhash(texts, "_text", width).drop("_text"))
    classes = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    edges = links(classes.select("fp"), radius, tile)
    if similar:
        edges = near_copies.similar_links(texts, marked, edges, width, *similar)
        marked = marked.select("doc_id", "fp")
    roots = connected_components(edges)
    grouped = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    return marked, grouped, durable(grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, tile: int = 2048, similar: tuple[int, float] | None = None) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; a component is named by its least id.

    ``similar``, a shingle width and a least similarity, also links all texts whose shingle sets are that similar.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    marked, grouped, named = grouped_fingerprints(texts, width, radius, tile, similar)
    owner = durable(lookup(grouped, named, "root", "members", grouped.count()).select("fp", "component_id", "rows"))
    return lookup(marked, owner, "fp", "rows", marked.count()).select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, width: int = 3, radius: int = 2, tile: int = 2048, similar: tuple[int, float] | None = None) -> DataFrame:
    """One row of ``docs`` a component, columns unchanged: that of the least id; of rows that share it, that of the least text hash.

    A null id is greater than all others.
    """
    mark = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    *_, named = grouped_fingerprints(docs.select(mark.alias("doc_id"), F.col("text").alias("_text")), width, radius, tile, similar)
    rows = docs.select(packed(docs).alias("row"), mark.alias("mark"))
    best = named.select(F.col("component_id.id").alias("_id"), F.col("component_id.text").alias("_hash"))
    kept = rows.join(best, F.col("mark.id").eqNullSafe(F.col("_id")) & (F.col("mark.text") == F.col("_hash")), "left_semi")
    again = docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_again"))
    if again.isEmpty():
        return kept.select("row.*")
    same = F.col("mark.id").eqNullSafe(F.col("_again"))
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["mark"])).select("row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 3-word shingles, 2 bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
ORACLE_SQL: dict[str, str] = {}
