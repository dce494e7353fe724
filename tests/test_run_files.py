"""Recorded run files: blocks as columns, runs of blocks as partitions, pruned and wide reads, damage, writing."""

import random
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitweave.sources import blocks as B
from hitweave.sources import recorded, run_files
from hitweave.sources.msgpack import pack

MAGIC = b"TESTRUN1"


def compact(value):
    """MessagePack with the shortest form of every integer, as other writers choose it."""
    if isinstance(value, (list, tuple)):
        n = len(value)
        head = bytes([0x90 | n]) if n < 16 else b"\xdc" + struct.pack(">H", n) if n < 1 << 16 else b"\xdd" + struct.pack(">I", n)
        return head + b"".join(map(compact, value))
    if isinstance(value, int) and not isinstance(value, bool):
        if -32 <= value < 128:
            return bytes([value & 255])
        for tag, kind, low, high in ((0xCC, ">B", 0, 255), (0xCD, ">H", 0, 65535), (0xCE, ">I", 0, 2**32 - 1), (0xCF, ">Q", 0, 2**64 - 1),
                                     (0xD0, ">b", -128, 0), (0xD1, ">h", -(2**15), 0), (0xD2, ">i", -(2**31), 0), (0xD3, ">q", -(2**63), 0)):
            if low <= value <= high:
                return bytes([tag]) + struct.pack(kind, value)
    return pack(value)


def waveform(rng):
    analog = [[rng.randrange(-(2**15), 2**15) for _ in range(rng.choice([0, 3, 20, 300]))] for _ in range(3)]
    digital = [[rng.randrange(2) for _ in range(rng.choice([0, 0, 5, 70]))] for _ in range(16)]
    return [*analog, *digital, rng.randrange(256), rng.randrange(65536), 2.0, True, False, rng.random() < 0.5, [1, 2, 255], [rng.randrange(256) for _ in range(16)]]


def event(rng, waves=0.2):
    return [rng.randrange(4), rng.randrange(200), rng.randrange(65536), rng.randrange(65536), rng.random() * 1e12, rng.choice([0, 1, 2**63 + 5, 2**40]),
            [rng.choice([0, 127, 128, 2**33, 2**64 - 1]) for _ in range(4)], waveform(rng) if rng.random() < waves else None]


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def expected(source, sequence, e):
    """The wide row of an event."""
    w = e[7] or [None] * len(B.WAVEFORM)
    return (source, sequence, *e[:5], signed(e[5]), tuple(map(signed, e[6])), e[7] is not None, *(tuple(x) if isinstance(x, list) else x for x in w))


WIDE = ["source_id", "sequence_number", *B.EVENT[:-1], "has_waveform", *B.WAVEFORM]


def frozen(row):
    return tuple(tuple(x) if isinstance(x, list) else x for x in row)


@pytest.mark.parametrize("packer", [pack, compact])
@pytest.mark.parametrize("events", [0, 1, 7, 200])
def test_a_block_as_columns(packer, events):
    rng = random.Random(events)
    rows = [event(rng) for _ in range(events)]
    found = B.Block(packer([9, 2**33, 5, rows])).columns(WIDE)
    got = [frozen(r) for r in zip(*(found[c].to_pylist() for c in WIDE))]
    assert got == [expected(9, 2**33, e) for e in rows]


def test_short_and_grown_events():
    old, grown = [1, 2, 3, 4, 5.5], [1, 2, 3, 4, 5.5, 7, [1, 2, 3, 4], None, 99, [1, [2, 3]]]
    found = B.Block(compact([0, 0, 0, [old, grown, old]])).columns(["energy", "flags", "user_info", "has_waveform"])
    assert [found[c].to_pylist() for c in found] == [[3, 3, 3], [0, 7, 0], [[], [1, 2, 3, 4], []], [False] * 3]


def test_damaged_blocks_are_refused():
    rng = random.Random(3)
    whole = compact([0, 0, 0, [event(rng) for _ in range(20)]])
    for raw in (whole[:-1], whole + b"\x00", whole[:40], b"\xc1" + whole, compact([0, 0, 0]), compact([0, 0, 0, 5]), b"\x05", compact([0, 0, 0, [1, 2]])):
        with pytest.raises(ValueError):
            B.Block(raw).columns(list(B.HIT))


def test_unasked_fields_are_not_decoded(monkeypatch):
    block = B.Block(compact([0, 0, 0, [event(random.Random(1), 1.0) for _ in range(5)]]))
    read = []
    for name in ("whole", "real"):
        monkeypatch.setattr(block, name, lambda values, f=getattr(block, name): read.append(len(values)) or f(values))
    assert len(block.columns(["energy", "timestamp_ns"])) == 2 and [n for n in read if n] == [5, 5]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A file of 100 blocks, a cut one, one with a damaged block in its middle, one that is something else."""
    out, rng = tmp_path_factory.mktemp("runs"), random.Random(4)
    batches = [(n % 3, n, 0, [event(rng) for _ in range(rng.choice([0, 1, 30]))]) for n in range(100)]
    whole = recorded.write_run(batches, MAGIC, {"version": 3})
    (out / "a.run").write_bytes(whole)
    (out / "b.run").write_bytes(recorded.write_run(batches[:10], MAGIC)[: -recorded.FOOTER - 3])
    torn = bytearray(recorded.write_run(batches[:40], MAGIC))
    at, number = 8 + 4 + struct.unpack_from("<I", torn, 8)[0], 0
    while number < 20:
        at, number = at + 4 + struct.unpack_from("<I", torn, at)[0], number + 1
    torn[at + 4] = 0xC1
    (out / "c.run").write_bytes(bytes(torn))
    (out / "d.run").write_bytes(b"something else")
    return out, batches


def test_a_file_is_read_by_many_tasks(spark, folder):
    out, batches = folder
    runs = run_files.index(spark, f"{out}/a.run", MAGIC, 20_000).collect()
    assert len(runs) > 8 and sum(r.blocks for r in runs) == 100 and [r.first for r in runs] == list(np.cumsum([0, *(r.blocks for r in runs)])[:-1])
    found = run_files.read(spark, f"{out}/a.run", MAGIC, WIDE, "FAILFAST", 20_000)
    tasks = found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 3 and Counter(frozen(r) for r in found.collect()) == Counter(expected(s, n, e) for s, n, _, es in batches for e in es)


@pytest.mark.parametrize("run_bytes", [50_000, 1 << 30])
def test_a_bad_block_ends_its_file(spark, folder, run_bytes):
    out, batches = folder
    found = run_files.read(spark, str(out), MAGIC, ["file", "block", "energy", "timestamp_ns"], "PERMISSIVE", run_bytes)
    good = {"a.run": 100, "b.run": 9, "c.run": 20}
    want = Counter((f, n, e[2], e[4]) for f, k in good.items() for _, n, _, es in batches[:k] for e in es)
    assert Counter((r.file.rsplit("/", 1)[1], r.block, r.energy, r.timestamp_ns) for r in found.collect()) == want
    for name in ("b.run", "c.run", "d.run"):
        with pytest.raises(Exception):
            run_files.read(spark, f"{out}/{name}", MAGIC, ["energy"], "FAILFAST", run_bytes).count()


def test_the_format_by_name(spark, folder, tmp_path):
    out, batches = folder
    run_files.register(spark)
    source = spark.read.format("recorded").option("magic", MAGIC.decode()).option("columns", "module, energy").option("runBytes", 20_000)
    found = source.load(f"{out}/a.run")
    assert found.columns == ["module", "energy"] and found.rdd.getNumPartitions() > 8
    assert Counter(map(tuple, found.collect())) == Counter((e[0], e[2]) for *_, es in batches for e in es)


def test_written_files_are_read_again(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i // 100 % 2, *event(rng, 0)[:5], i, [i, 2, 3, 4]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "source_id long, module int, channel int, energy int, energy_short int, timestamp_ns double, flags long, user_info array<long>").repartition(3)
    run_files.register(spark)
    write = frame.write.format("recorded").option("magic", MAGIC.decode()).option("runNumber", 7).option("experiment", "exp").option("batchEvents", 50).option("maxBytes", 20_000)
    write.mode("append").save(str(tmp_path / "out"))
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(names) > 6 and all(n.startswith("run0007_") and n.endswith("_exp.run") and (tmp_path / "out" / n).stat().st_size < 25_000 for n in names)
    found = run_files.read(spark, str(tmp_path / "out"), MAGIC, ["source_id", *B.EVENT[:-1]])
    assert Counter(frozen(r) for r in found.collect()) == Counter(frozen(r) for r in rows)
    feet = recorded.footers(spark, str(tmp_path / "out")).collect()
    assert all(f.ok and f.complete for f in feet) and sum(f.events for f in feet) == 3000
    last = {r.file: (r.block, int(r.checksum, 16)) for r in recorded.validate(spark, str(tmp_path / "out"), MAGIC).orderBy("block").collect()}
    assert {f.file: int(f.checksum, 16) for f in feet} == {f.file: last[f.file][1] ^ f.bytes for f in feet}
    write.mode("append").save(str(tmp_path / "out"))
    assert len(set(p.name for p in (tmp_path / "out").iterdir())) == 2 * len(names)
