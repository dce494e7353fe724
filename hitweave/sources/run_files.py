"""Recorded run files read by many tasks each: runs of blocks are the partitions, and only the columns asked for are decoded.

:func:`index` finds where blocks begin, by their length prefixes alone, and cuts each file into runs of about ``run_bytes``; :func:`read` decodes each
run in a task of its own. The same files can be read with ``spark.read.format("recorded")`` after :func:`register`, and written with
``df.write.format("recorded")``. Files are opened through Arrow's file systems, so a run reads its own bytes only.

A bad block ends its file: in ``PERMISSIVE`` mode what came before is kept, for which every run is first looked through for
blocks that cannot be parsed; in ``FAILFAST`` mode the job stops at it, and each byte is read once.
"""

from __future__ import annotations

import struct
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema

from . import blocks as B
from .msgpack import pack
from .recorded import FOOTER, MAX_BLOCK, MIN_BLOCK, closing, rolled

RUN_BYTES = 32 << 20
RUNS = "file string, run long, first long, offset long, blocks long, bytes long, error string"
PLACE = {"file": pa.string(), "block": pa.int64()}


def opened(path: str) -> pa.NativeFile:
    """A file of any of Arrow's file systems, for reading at any place."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    system, inside = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return system.open_input_file(inside)


def runs_of(path: str, magic: bytes, run_bytes: int) -> Iterator[tuple]:
    """Rows of :data:`RUNS` of a file, by seeking from length to length; the last run tells why the file ends before its footer, if it does."""
    with opened(path) as file:
        size = file.size()
        head = file.read_at(len(magic) + 4, 0)
        if head[: len(magic)] != magic or len(head) < len(magic) + 4:
            yield path, 0, 0, 0, 0, 0, "no header"
            return
        at = len(magic) + 4 + struct.unpack("<I", head[len(magic) :])[0]
        end = size - FOOTER if size >= FOOTER and file.read_at(8, size - FOOTER) == b"FOOTER01" else size
        run, first, start, number, error = 0, 0, at, 0, None
        while at < end:
            prefix = file.read_at(4, at) if at + 4 <= end else b""
            length = struct.unpack("<I", prefix)[0] if prefix else 0
            if not MIN_BLOCK <= length <= MAX_BLOCK or at + 4 + length > end:
                error = f"bad block length {length}"
                break
            if at > start and at + 4 + length - start > run_bytes:
                yield path, run, first, start, number - first, at - start, None
                run, first, start = run + 1, number, at
            at, number = at + 4 + length, number + 1
        if number > first or error:
            yield path, run, first, start, number - first, at - start, error


def blocks_of(path: str, first: int, offset: int, blocks: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Number and bytes of each block of a run."""
    with opened(path) as file:
        data, at = memoryview(file.read_at(size, offset)), 0
        for number in range(first, first + blocks):
            length = struct.unpack_from("<I", data, at)[0]
            yield number, data[at + 4 : at + 4 + length]
            at += 4 + length


def index(spark: SparkSession, path: str, magic: bytes, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Runs of blocks of all files under ``path``, one row each; files are dealt to tasks, and their blocks are not read."""
    files = spark.read.format("binaryFile").load(path).select("path")  # without the content column, contents stay unread
    names = [f.split()[0] for f in RUNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = list(runs_of(file, magic, run_bytes))
                kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return files.mapInArrow(run, RUNS)


def first_bad(runs: DataFrame) -> DataFrame:
    """``file, bad``: the first block of each file that cannot be parsed. Runs are looked through in parallel, whole."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for number, raw in blocks_of(row["file"], row["first"], row["offset"], row["blocks"], row["bytes"]):
                    try:
                        B.Block(raw).columns([*B.HIT, "has_waveform"])
                    except (ValueError, IndexError):
                        yield pa.RecordBatch.from_arrays([pa.array([row["file"]]), pa.array([number], pa.int64())], ["file", "bad"])
                        break

    return runs.mapInArrow(look, "file string, bad long").groupBy("file").agg(F.min("bad").alias("bad"))


def arrow_schema(columns: list[str]) -> pa.Schema:
    return pa.schema([(c, (PLACE | B.COLUMNS)[c]) for c in columns])


def decoded_run(schema: pa.Schema, file: str, first: int, offset: int, blocks: int, size: int) -> Iterator[pa.RecordBatch]:
    """The columns of ``schema`` of every event of a run, a batch a block."""
    for number, raw in blocks_of(file, first, offset, blocks, size):
        block = B.Block(raw)
        found = block.columns([c for c in schema.names if c not in PLACE])
        rows = len(block.events)
        found |= {c: pa.array([v] * rows, PLACE[c]) for c, v in (("file", file), ("block", number)) if c in schema.names}
        yield pa.RecordBatch.from_arrays([found[c] for c in schema.names], schema=schema)


def read(spark: SparkSession, path: str, magic: bytes, columns: list[str] | None = None, mode: str = "PERMISSIVE", run_bytes: int = RUN_BYTES) -> DataFrame:
    """The named columns, of ``file``, ``block`` and :data:`blocks.COLUMNS`, of every event of all files under ``path``; by default those of a hit.

    Each run of blocks is a task's work. All columns of a waveform together are the wide form, one column a field and probe.
    """
    names = list(columns or ("file", "block", *B.HIT))
    runs = index(spark, path, magic, run_bytes)
    total = spark.read.format("binaryFile").load(path).agg(F.sum(F.ceil(F.col("length") / run_bytes))).first()[0] or 1
    dealt = runs.repartition(int(total))
    if mode == "FAILFAST":
        dealt = dealt.withColumn("blocks", F.when(F.col("error").isNotNull(), F.raise_error(F.concat("file", F.lit(": "), "error"))).otherwise(F.col("blocks")).cast("long"))
    else:
        cut = dealt.join(first_bad(dealt), "file", "left").withColumn("blocks", F.least("blocks", F.col("bad") - F.col("first")))
        dealt = cut.select(*runs.columns).repartition(int(total))
    schema = arrow_schema(names)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["blocks"] > 0:
                    yield from decoded_run(schema, row["file"], row["first"], row["offset"], row["blocks"], row["bytes"])

    return dealt.mapInArrow(decode, from_arrow_schema(schema))


class Recorded(DataSource):
    """``spark.read.format("recorded")`` with the options ``magic``, ``columns`` (names between commas) and ``runBytes``; ``load`` names a file or a folder.

    Writing takes the columns of a hit and the options ``magic``, ``runNumber``, ``experiment``, ``batchEvents``, ``maxBytes`` and ``maxSeconds``.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> T.StructType:
        return from_arrow_schema(arrow_schema([c.strip() for c in self.options.get("columns", ",".join(("file", "block", *B.HIT))).split(",")]))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RunReader(schema.names, self.options["path"], self.options["magic"].encode(), int(self.options.get("runBytes", RUN_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RunWriter(schema.names, dict(self.options))


class RunReader(DataSourceReader):
    """One partition a run of blocks; a bad block fails its task. Lengths are read by the driver: for very many files take :func:`read`."""

    def __init__(self, columns: list[str], path: str, magic: bytes, run_bytes: int) -> None:
        self.columns, self.path, self.magic, self.run_bytes = columns, path, magic, run_bytes

    def partitions(self) -> list[InputPartition]:
        runs = [run for file in listed(self.path) for run in runs_of(file, self.magic, self.run_bytes)]
        return [InputPartition((r[0], r[2], r[3], r[4], r[5], r[6])) for r in runs] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is not None:
            *run, error = partition.value
            if error:
                raise ValueError(f"{run[0]}: {error}")
            yield from decoded_run(arrow_schema(self.columns), *run)


def listed(path: str) -> list[str]:
    """A file, or the files of a folder that are not hidden."""
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    bare = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    system, inside = pafs.FileSystem.from_uri(bare) if "://" in bare else (pafs.LocalFileSystem(), bare)
    info = system.get_file_info(inside)
    if info.type == pafs.FileType.File:
        return [path]
    found = [f for f in system.get_file_info(pafs.FileSelector(inside)) if f.type == pafs.FileType.File and f.base_name[0] not in "._"]
    prefix = "" if not scheme or path.startswith("file:") else scheme
    return sorted(prefix + f.path for f in found)


def waves(at: dict[str, list], rows: int) -> list[list | None]:
    """The waveform of each row, from the columns of its fields that are there; none where they are all null."""
    here = [c for c in B.WAVEFORM if c in at]
    if not here:
        return [None] * rows
    empty = {c: [] if pa.types.is_list(k) else 0.0 if k == pa.float64() else False if k == pa.bool_() else 0 for c, k in B.COLUMNS.items()}
    empty |= {"analog_probe_type": [255] * 3, "digital_probe_type": [255] * 16}
    found = []
    for i in range(rows):
        given = {c: at[c][i] for c in here if at[c][i] is not None}
        found.append([given.get(c, empty[c]) for c in B.WAVEFORM] if given else None)
    return found


class RunWriter(DataSourceArrowWriter):
    """Files ``run0007_0000_name`` and on, each a header, blocks and a footer; a task ends a file at ``maxBytes`` or after ``maxSeconds`` and begins the next.

    Tasks have number ranges of their own, so that a task run again writes the same files; where the folder holds files of the run already, all new names get the time appended and
    nothing is overwritten. A batch holds hits of one source in their order. The driver adds nothing.
    """

    def __init__(self, columns: list[str], options: dict[str, str]) -> None:
        missing = [c for c in ("module", "channel", "energy", "energy_short", "timestamp_ns") if c not in columns]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        self.columns, self.folder, self.magic = columns, options["path"], options["magic"].encode()
        self.run, self.experiment = int(options.get("runnumber", 0)), options.get("experiment", "") or "data"
        self.batch, self.most = int(options.get("batchevents", 4096)), int(options.get("maxbytes", 1 << 30))
        self.seconds, self.header = float(options.get("maxseconds", 600)), {"version": 3, "run_number": self.run, "exp_name": self.experiment}
        system, inside = self._system()
        system.create_dir(inside, recursive=True)
        old = [f.base_name for f in system.get_file_info(pafs.FileSelector(inside)) if f.base_name.startswith(f"run{self.run:04d}_")]
        self.suffix = f"_{time.time_ns()}" if old else ""

    def _system(self) -> tuple[pafs.FileSystem, str]:
        path = "/" + self.folder.removeprefix("file:").lstrip("/") if self.folder.startswith("file:") else self.folder
        return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, inside = self._system()
        part, made, out = TaskContext.get().partitionId(), 0, None
        sequences: dict[int, int] = {}

        def block(rows: list[tuple], source: int) -> bytes:
            number = sequences.get(source, 0)
            sequences[source] = number + 1
            return pack([source, number, 0, rows])

        def begin() -> list:
            nonlocal made
            file = system.open_output_stream(f"{inside}/run{self.run:04d}_{part * 10_000 + made:04d}_{self.experiment}{self.suffix}.run")
            made += 1
            head = pack(self.header | {"file_sequence": part * 10_000 + made - 1})
            file.write(self.magic + struct.pack("<I", len(head)) + head)
            return [file, 0, 0, 0, [], time.monotonic()]  # checksum, events, bytes, least and greatest time, begun

        def end() -> None:
            out[0].write(closing(out[1], out[2], out[3], out[4], True))
            out[0].close()

        for batch in iterator:
            at = {c: batch.column(i).to_pylist() for i, c in enumerate(self.columns)}
            rows, none = batch.num_rows, [None] * batch.num_rows
            sources = at.get("source_id", [0] * rows)
            user = at.get("user_info", none)
            events = list(zip(at["module"], at["channel"], at["energy"], at["energy_short"], at["timestamp_ns"], at.get("flags", [0] * rows), user, waves(at, rows)))
            of_source: dict[int, list] = {}
            for source, event in zip(sources, events):
                of_source.setdefault(source, []).append([*event[:6], list(event[6]) if event[6] else [0, 0, 0, 0], event[7]])
            for source, mine in of_source.items():
                for k in range(0, len(mine), self.batch):
                    some = mine[k : k + self.batch]
                    raw = block(some, source)
                    if out is not None and (out[3] + 4 + len(raw) > self.most or time.monotonic() - out[5] > self.seconds):
                        end()
                        out = None
                    out = out or begin()
                    out[0].write(struct.pack("<I", len(raw)) + raw)
                    times = [*out[4], *(e[4] for e in some)]
                    out[1], out[2], out[3], out[4] = rolled(out[1], raw), out[2] + len(some), out[3] + 4 + len(raw), [min(times), max(times)]
        if out is not None:
            end()
        return WriterCommitMessage()


def register(spark: SparkSession) -> None:
    """Makes the format ``recorded`` known to the session."""
    spark.dataSource.register(Recorded)
