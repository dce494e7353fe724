"""Raw read-outs: fixtures are put together word by word from hits that are known, and must come back; damage is reported."""

import random
import struct

import pytest

from hitweave.sources import aggregates as A
from hitweave.sources import blocks as B

NONE3, NONE16 = [255] * 3, [255] * 16
WIDE = [*A.HIT, "user_info", "has_waveform", *B.WAVEFORM]


def cut14(x):
    return x & 0x3FFF


def wave(rows, step, signs=(False, False, False), kinds=(NONE3, NONE16), **more):
    """Fields of a waveform from its probes."""
    w = {c: [] for c in (*B.ANALOG, *B.DIGITAL)} | rows
    return w | {"time_resolution": 0, "trigger_threshold": 0, "ns_per_sample": step, **dict(zip(B.SIGNED, signs)), "analog_probe_type": kinds[0], "digital_probe_type": kinds[1]} | more


def hit(w=None, user=(0, 0, 0, 0), **fields):
    return fields | {"user_info": list(user), "has_waveform": w is not None} | (w or dict.fromkeys(B.WAVEFORM))


def board32(rng, height, tag, counter, mask=None, kinds=range(5)):
    """Words of a board aggregate and its hits; ``tag`` is the board time."""
    body, hits = [], []
    mask = rng.randrange(1, 256) if mask is None else mask
    for pair in (p for p in range(8) if mask >> p & 1):
        groups, dual, option = rng.choice([0, 0, 1, 3]), rng.randrange(2), rng.choice([0, 1, 2, 5])
        wave_on, extra, physics = int(groups > 0), rng.randrange(2), 1
        rows, block = rng.randrange(4), []
        for _ in range(rows):
            channel, ticks, high, low, pile = rng.randrange(2), rng.randrange(1 << 31), rng.randrange(1 << (10 if height else 16)), rng.randrange(1 << 15), rng.randrange(2)
            block.append(channel << 31 | ticks)
            w = None
            if wave_on:
                analog = [rng.randrange(-8192, 8192) if height else rng.randrange(16384) for _ in range(groups * 8)]
                a, b = ([rng.randrange(2) for _ in analog] for _ in range(2))  # bits 14 and 15
                block += [cut14(analog[i]) | a[i] << 14 | b[i] << 15 | (cut14(analog[i + 1]) | a[i + 1] << 14 | b[i + 1] << 15) << 16 for i in range(0, len(analog), 2)]
                probes = {"analog_probe1": analog, "digital_probe1": b if height else a, "digital_probe2": a if height else b}
                if dual:
                    probes |= {"analog_probe1": [x for x in analog[1::2] for _ in "12"], "analog_probe2": [x for x in analog[::2] for _ in "12"]}
                w = wave(probes, 2.0, (height, height, False))
            fine, flags, time = 0, 0, ticks * 2.0
            if extra:
                ext, odd, f = rng.randrange(1 << 16), rng.randrange(64), rng.randrange(1024)
                if option == 5:
                    before, after = (rng.randrange(-500, 500), rng.randrange(-500, 500)) if height else (rng.randrange(16384), rng.randrange(16384))
                    block.append((before & 0xFFFF) << 16 | after & 0xFFFF)
                    part = 0.0 if before == after else min(max((before if height else 8192 - after) / (before - after), 0.0), 1.0)
                    fine = int(min(part * 1024, 1023))
                    full = tag >> 31 << 31 | ticks
                    time = (full - (1 << 31) if full > tag and full >= 1 << 31 else full) * 2.0 + part * 2.0
                else:
                    block.append(ext << 16 | (odd << 10 | f))
                    fine, flags = (f, odd) if option == 2 else (0, (odd << 10 | f)) if option == 1 else (0, 0)
                    time = (ext << 31 | ticks) * 2.0 + fine * (2.0 / 1024)
            block.append((high << 16 | pile << 15 | low))
            hits.append(hit(w, channel=2 * pair + channel, energy=low if height else high, energy_short=high if height else low, timestamp_ns=time, fine_time=fine, flags=flags | pile << 15))
        layout = groups | option << 24 | wave_on << 27 | extra << 28 | 1 << 29 | physics << 30 | dual << 31
        body += [len(block) + 2, layout, *block]
    return struct.pack(f"<{len(body) + 4}I", 0xA << 28 | len(body) + 4, mask, counter, tag & 0xFFFFFFFF, *body), hits


def words64(rng, height, rows, step=2.0):
    out, hits = [], []
    for _ in range(rows):
        kind, channel, energy, fl = rng.choice(["one", "two", "wave", "special", "long special"]), rng.randrange(32), rng.randrange(65536), rng.randrange(256)
        if kind == "one":
            time = rng.randrange(1 << 32)
            out.append(1 << 63 | channel << 56 | fl << 48 | time << 16 | energy)
            hits.append(hit(channel=channel, energy=energy, energy_short=0, timestamp_ns=time * step, fine_time=0, flags=fl << 12))
            continue
        time, low, short, fine = rng.randrange(1 << 48), rng.randrange(4096), rng.randrange(65536), rng.randrange(1024)
        if "special" in kind:
            out += [channel << 56 | 1 << 55 | time, (kind == "special") << 63 | rng.randrange(1 << 62)]
            out += [rng.randrange(1 << 63), 1 << 63 | rng.randrange(1 << 63)] if kind == "long special" else []
            continue
        out += [channel << 56 | time, (kind == "two") << 63 | (kind == "wave") << 62 | low << 50 | fl << 42 | short << 26 | fine << 16 | energy]
        w = None
        if kind == "wave":
            n, res, rest = rng.randrange(5), rng.randrange(4), rng.randrange(1 << 44)
            signs = (bool(rest >> 3 & 1), bool(rest >> 9 & 1), False) if height else (False,) * 3
            out += [1 << 63 | res << 44 | rest & ~(3 << 44), n]
            samples = [(rng.randrange(-8192, 8192) if signs[0] else rng.randrange(16384), rng.randrange(-8192, 8192) if signs[1] else rng.randrange(16384), *[rng.randrange(2) for _ in range(4)]) for _ in range(2 * n)]
            half = [cut14(a) | d1 << 14 | d2 << 15 | cut14(b) << 16 | d3 << 30 | d4 << 31 for a, b, d1, d2, d3, d4 in samples]
            out += [half[i] | half[i + 1] << 32 for i in range(0, 2 * n, 2)]
            names = ("analog_probe1", "analog_probe2", *[f"digital_probe{k}" for k in range(1, 5)])
            kinds = ([rest & 7, rest >> 6 & 7, 255], [rest >> 12 & 15, rest >> 16 & 15, rest >> 20 & 15, rest >> 24 & 15, *[255] * 12]) if height else (NONE3, NONE16)
            w = wave({c: [s[k] for s in samples] for k, c in enumerate(names)}, step, signs, kinds, time_resolution=res, trigger_threshold=rest >> 28 & 0xFFFF)
        hits.append(hit(w, channel=channel, energy=energy, energy_short=0 if height else short, timestamp_ns=time * step + fine / 1024 * step, fine_time=fine, flags=fl << 12 | low))
    return out, hits


def big(words):
    return struct.pack(f">{len(words)}Q", *words)


def lanes(rng, rows):
    out, hits = [], []
    for _ in range(rows):
        channel, special, traced, users = rng.randrange(4), rng.randrange(2), rng.randrange(2), [rng.randrange(1 << 63) for _ in range(rng.randrange(7))]
        time, low, fl, short, fine, energy = (rng.randrange(1 << b) for b in (48, 12, 8, 16, 10, 16))
        out += [channel << 56 | special << 55 | time, (not users) << 63 | traced << 62 | low << 50 | fl << 42 | short << 26 | fine << 16 | energy]
        out += [u | (k == len(users) - 1) << 63 for k, u in enumerate(users)]
        w = None
        if traced:
            n = rng.randrange(6)
            four = [tuple(rng.randrange(-32768, 32768) for _ in range(3)) + (rng.randrange(65536),) for _ in range(n)]
            out += [n, *[a & 0xFFFF | (b & 0xFFFF) << 16 | (c & 0xFFFF) << 32 | d << 48 for a, b, c, d in four]]
            if special:
                probes = {f"analog_probe{k + 1}": [s[k] for s in four] for k in range(3)} | {f"digital_probe{k + 1}": [s[3] >> (15 - k) & 1 for s in four] for k in range(5)}
                w = wave(probes, 8.0, (True,) * 3, ([0x40, 0x41, 0x42], [0x40, 0x41, 0x42, 0x43, 0x44, *[255] * 11]))
            else:
                w = wave({"analog_probe1": [x if x < 32768 else x - 65536 for s in four for x in s]}, 8.0)
        hits.append(hit(w, user=[*users, 0, 0, 0, 0][:4], channel=channel, energy=energy, energy_short=short, timestamp_ns=time * 8.0 + fine / 1024 * 8.0, fine_time=fine, flags=fl << 12 | low))
    return big(out), hits


def rows_of(found):
    made = dict(zip(WIDE, A.arrow_columns(found, WIDE)))
    return [dict(zip(WIDE, r)) for r in zip(*(made[c].to_pylist() for c in WIDE))]


def in_time(hits):
    return sorted(hits, key=lambda h: h["timestamp_ns"])


@pytest.mark.parametrize("height", [False, True])
@pytest.mark.parametrize("seed", range(6))
def test_boards_of_the_32_bit_families(height, seed):
    rng = random.Random(seed)
    tags = [rng.randrange(1 << 35) for _ in range(5)]
    made = [board32(rng, height, t, n) for n, t in enumerate(tags)]
    found = A.events32(b"".join(b for b, _ in made), height, 2.0, tags)
    assert rows_of(found) == in_time([h for _, hs in made for h in hs]) and found.faults == []


@pytest.mark.parametrize("height", [False, True])
@pytest.mark.parametrize("seed", range(6))
def test_aggregates_of_the_64_bit_families(height, seed):
    rng = random.Random(seed)
    body, hits = words64(rng, height, 40 * seed)
    found = A.events64(big([0x2 << 60 | len(body) + 1, *body]), height, 2.0, 32)
    assert rows_of(found) == in_time(hits)
    assert all(f.startswith("special events") for _, f in found.faults) or not body


@pytest.mark.parametrize("seed", range(6))
def test_read_outs_with_user_words_and_four_lanes(seed):
    raw, hits = lanes(random.Random(seed), 1 + 20 * seed)
    found = A.events_lanes(raw)
    if len(raw) >= 32:
        assert rows_of(found) == hits and {f.split(":")[0] for _, f in found.faults} <= {"over four user words"}


def test_damage_of_32_bit_read_outs():
    rng = random.Random(2)
    good = [board32(rng, False, 5, n, 0xFF) for n in (1, 2, 4)]
    a, b, c = (x for x, _ in good)
    count = [len(h) for _, h in good]
    for raw, hits, faults in (
        (a + b + c, sum(count), ["aggregate missing"]), (a + b[:-4], count[0], ["aggregate past the end"]), (a + b"\0" * 16 + b, count[0], ["no board aggregate"]),
        (a + struct.pack("<4I", 0xA << 28, 0, 2, 0) + b, count[0], ["aggregate without a head"]), (a + b[:8], count[0], []), (a[:-1], 0, ["no whole words"]), (b"", 0, ["too short"]),
        (struct.pack("<2I", 0xA << 28 | 9, 1 << 26 | 1) + struct.pack("<7I", 1, 0, 5, 1 << 29 | 1 << 30, 7, 9 << 16, 3), 1, ["board failed", "event cut off"]),
    ):
        found = A.events32(raw, False, 2.0, [])
        assert (found.rows, [f for _, f in found.faults]) == (hits, faults)


def test_damage_of_64_bit_read_outs():
    one, two = 1 << 63 | 3 << 56 | 7 << 16 | 9, [4 << 56 | 100, 1 << 63 | 5]
    data = lambda *w, size=None: big([0x2 << 60 | (size or len(w) + 1), *w])
    for raw, hits, faults in (
        (data(one, *two), 2, []), (data(one, *two, size=9), 2, ["size differs", "words do not fit the size"]), (data(one, two[0]), 1, ["words do not fit the size", "event cut off"]),
        (data(4 << 56, 1 << 62, 1 << 63 | 17 << 56, one), 3, ["no waveform where one was due"]), (data(4 << 56, 1 << 62, 1 << 63, 5, 0), 1, ["words do not fit the size", "waveform cut off"]),
        (data(40 << 56 | 1 << 63), 1, ["channels from 32 on: 1"]), (big([0x5 << 60, 1]), 0, ["no data aggregate"]), (big([1]), 0, ["too short"]),
        (big([0x3 << 60, 0, 0, 0]), 0, ["start signal"]), (big([0x3 << 60 | 0x2 << 56, 0, 0]), 0, ["stop signal"]), (big([0x2 << 60 | 1 << 56 | 2, one]), 1, ["board failed"]),
    ):
        found = A.events64(raw, False, 2.0, 32)
        assert (found.rows, [f for _, f in found.faults]) == (hits, faults)
    cut = A.events_lanes(big([1 << 56, 1 << 63, 1 << 56, 1 << 63, 1 << 56]))
    assert (cut.rows, cut.faults) == (2, [(32, "event cut off")])


def test_hits_of_files_of_read_outs(spark, tmp_path):
    """From files to hits with samples, one read-out a file, over all families; nulls and empty read-outs have no hits."""
    rng, want = random.Random(9), []
    for n in range(6):
        body, hits = words64(rng, True, 30)
        (tmp_path / f"{n}.raw").write_bytes(big([0x2 << 60 | len(body) + 1, *body]))
        want += [(f"{n}.raw", k, h["channel"], h["energy"], h["analog_probe1"]) for k, h in enumerate(in_time(hits))]
    raw = spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("element_at(split(path, '/'), -1) AS `a.b`", "content")
    raw = raw.unionByName(spark.createDataFrame([(None, None), ("e", b"")], raw.schema))
    found = A.decode(raw, "height64", ["a.b"], columns=["channel", "energy", "analog_probe1"])
    assert sorted(map(tuple, found.collect()), key=lambda r: r[:2]) == want
    odd = {(r[0], r.fault.split(":")[0]) for r in A.faults(raw, "height64", ["a.b"]).collect()}
    assert odd == {(None, "too short"), ("e", "too short"), *((f"{n}.raw", "special events") for n in range(6))}
    with pytest.raises(ValueError):
        A.events(b"", "other", 2.0, 1, [])


def test_board_times_go_on_over_read_outs(spark):
    """Interpolated times need the extended board time, which wraps and once comes late."""
    rng, rows, wide, want = random.Random(4), [], 0xE0000000, {}
    for n in range(12):
        made = []
        for k in range(2):
            wide += rng.randrange(1 << 27)
            made.append((wide if (n, k) != (0, 1) else 0, n * 2 + k))
        parts = [board32(rng, False, (made[0][0] if (n, k) == (0, 1) else tag), count) for k, (tag, count) in enumerate(made)]
        raw = b"".join(p for p, _ in parts)
        if n == 0:  # the second board time of the first read-out is behind the first and has no epoch: the first one holds
            at = len(parts[0][0]) + 12
            raw = raw[:at] + struct.pack("<I", (made[0][0] - 9) & 0xFFFFFFFF) + raw[at + 4 :]
        rows.append((1, n, raw))
        want[n] = [h["timestamp_ns"] for h in in_time([h for _, hs in parts for h in hs])]
    raw = spark.createDataFrame(rows, "module int, seq long, content binary").repartition(3)
    found = A.decode(A.board_times(raw, "module", "seq"), "charge32", ["module", "seq"], board_time="board_time").collect()
    got = {n: [r.timestamp_ns for r in sorted(found, key=lambda r: (r.seq, r.place)) if r.seq == n] for n in want}
    assert got == want
