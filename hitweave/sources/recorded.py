"""Recorded run files: header, length-prefixed blocks of event batches, 64-byte footer.

Hits are read by runs of blocks, see ``run_files``. What works on files whole, validation, recovery and streams of files, takes them from Spark's
``binaryFile`` reader, one file a row. A bad block ends its file:
in ``PERMISSIVE`` mode what came before is kept, in ``FAILFAST`` mode the job stops. The file
magic is a parameter.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .msgpack import pack, unpack

#: Fixed values of the format: least and greatest block size in bytes, and the footer's size.
MIN_BLOCK, MAX_BLOCK, FOOTER = 1, 100 * 1024 * 1024, 64

HITS = "file string, block long, source_id long, sequence_number long, module int, channel int, energy int, energy_short int, timestamp_ns double, flags long, user_info array<long>"
BLOCKS = "file string, block long, bytes long, events long, checksum string, ok boolean, error string"


def write_run(batches: list[tuple[int, int, int, list]], magic: bytes, header: dict | None = None, complete: bool = True) -> bytes:
    """The bytes of a file of batches ``(source_id, sequence_number, timestamp, events)``; events are positional lists."""
    head = pack(header or {"version": 3})
    out = [magic, struct.pack("<I", len(head)), head]
    state, events, size, times = 0, 0, 0, []
    for batch in batches:
        block = pack(list(batch))
        state = rolled(state, block)
        events, size = events + len(batch[3]), size + 4 + len(block)
        times += [e[4] for e in batch[3]]
        out += [struct.pack("<I", len(block)), block]
    return b"".join(out) + closing(state, events, size, times, complete)


def closing(state: int, events: int, size: int, times: list[float], complete: bool) -> bytes:
    footer = struct.pack("<8sQQQddd?", b"FOOTER01", state ^ size, events, size, min(times, default=0.0), max(times, default=0.0), 0.0, complete)
    return footer.ljust(FOOTER, b"\0")


def rolled(state: int, block: bytes) -> int:
    """Order-dependent checksum of the length prefix, then of the block: rotated by 5, then crossed with the hash."""
    for part in (struct.pack("<I", len(block)), block):
        state = ((state << 5 | state >> 59) & (1 << 64) - 1) ^ xxhash.xxh64_intdigest(part, 0)
    return state


def blocks(data: bytes, magic: bytes) -> Iterator[tuple[int, bytes, str | None]]:
    """``(number, bytes, error)`` of each block; an error is the last. A file cut off has no footer."""
    if data[: len(magic)] != magic or len(data) < len(magic) + 4:
        yield 0, b"", "no header"
        return
    at = len(magic)
    at += 4 + struct.unpack_from("<I", data, at)[0]
    end, number = len(data) - FOOTER * (data[-FOOTER:][:8] == b"FOOTER01"), 0
    while at < end:
        size = struct.unpack_from("<I", data, at)[0] if at + 4 <= end else 0
        if not MIN_BLOCK <= size <= MAX_BLOCK or at + 4 + size > end:
            yield number, b"", f"bad block length {size}"
            return
        yield number, data[at + 4 : at + 4 + size], None
        at, number = at + 4 + size, number + 1


def decode(block: bytes) -> tuple[int, int, list]:
    source, sequence, _, events = unpack(block)[0]
    return source, sequence, events


def read_hits(spark: SparkSession, path: str, magic: bytes, mode: str = "PERMISSIVE") -> DataFrame:
    """One row a hit of all files under ``path``; see :func:`run_files.read`."""
    from .run_files import read

    return read(spark, path, magic, mode=mode)


def replay(spark: SparkSession, path: str, magic: bytes, files: int = 1, mode: str = "PERMISSIVE") -> DataFrame:
    """The same rows as a stream, ``files`` of them a micro-batch, the oldest first."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return decoded(stream.option("maxFilesPerTrigger", files).load(path), magic, mode)


def recover(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    """``file, content, blocks, events`` of each file with a header: its readable blocks up to the first bad one under a new footer."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for file, content in zip(pdf["path"], pdf["content"]):
                state, events, size, times, number = 0, 0, 0, [], 0
                start = len(magic) + 4 + struct.unpack_from("<I", content.ljust(len(magic) + 4, b"\0"), len(magic))[0]
                if content[: len(magic)] != magic or len(content) < start:
                    continue
                for number, block, error in blocks(content, magic):
                    try:
                        found = None if error else decode(block)[2]
                    except (ValueError, IndexError, struct.error):
                        found = None
                    if found is None:
                        break
                    state, events, size = rolled(state, block), events + len(found), size + 4 + len(block)
                    times += [e[4] for e in found]
                    number += 1
                good = content[: start + size] + closing(state, events, size, times, True)
                yield pd.DataFrame([(file, good, number, events)], columns=["file", "content", "blocks", "events"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, content binary, blocks long, events long")


def headers(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    """Size and header of each file, the header as JSON; null where there is none. Blocks are not decoded."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"]):
                try:
                    head = json.dumps(unpack(content, len(magic) + 4)[0], default=str) if content[: len(magic)] == magic else None
                except (ValueError, IndexError, struct.error):
                    head = None
                rows.append((file, len(content), head))
            yield pd.DataFrame(rows, columns=["file", "bytes", "header"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, bytes long, header string")


def decoded(files: DataFrame, magic: bytes, mode: str) -> DataFrame:
    """One row a hit of ``files`` with ``path`` and ``content``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in HITS.split(", ")]
        for pdf in frames:
            for file, content in zip(pdf["path"], pdf["content"]):
                for number, block, error in blocks(content, magic):
                    try:
                        if error:
                            raise ValueError(error)
                        source, sequence, events = decode(block)
                    except (ValueError, IndexError, struct.error):
                        if mode == "FAILFAST":
                            raise
                        break
                    yield pd.DataFrame([(file, number, source, sequence, *e[:6], e[6]) for e in events], columns=names)

    return files.select("path", "content").mapInPandas(run, HITS)


def validate(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    """One row a block: whether it can be read, its event count and the running checksum."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        for pdf in frames:
            for file, content in zip(pdf["path"], pdf["content"]):
                rows, state = [], 0
                for number, block, error in blocks(content, magic):
                    state = rolled(state, block)
                    try:
                        events = len(decode(block)[2]) if error is None else 0
                    except (ValueError, IndexError, struct.error) as problem:
                        events, error = 0, str(problem)
                    rows.append((file, number, len(block), events, f"{state:016x}", error is None, error))
                    if error:
                        break
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, BLOCKS)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """The footer of each file and whether its checksum matches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"]):
                mark, check, events, size, first, last, _, complete = struct.unpack_from("<8sQQQddd?", content[-FOOTER:])
                rows.append((file, mark == b"FOOTER01", f"{check:016x}", events, size, first, last, complete))
            yield pd.DataFrame(rows, columns=["file", "ok", "checksum", "events", "bytes", "first_ns", "last_ns", "complete"])

    schema = "file string, ok boolean, checksum string, events long, bytes long, first_ns double, last_ns double, complete boolean"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)
