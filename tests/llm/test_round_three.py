"""Repair, packing and spelling: registered queries and operators against SQL, brute force and exact round trips, on odd rows too."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hitweave.llm import packing, repair, spelling

MESSAGES = "conv_id long, turn long, role string, text string"
TEXTS = "doc_id long, text string"


def by_sql(sql, **frames):
    con = duckdb.connect()
    for name, (rows, ddl) in frames.items():
        con.sql(f"CREATE TABLE {name} ({', '.join(c.replace(' string', ' varchar').replace(' long', ' bigint') for c in ddl.split(', '))})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' for _ in rows[0])})", rows)
    found = con.sql(sql)
    return Counter(tuple(sorted(zip(found.columns, row))) for row in found.fetchall())


def counted(frame):
    return Counter(tuple(sorted(r.asDict().items())) for r in frame.collect())


def talk(seed, conversations=60, long=90):
    rng, rows = random.Random(seed), []
    for conv in [*range(conversations), None]:
        for turn in range(rng.choice([1, 2, 4, 8, long])):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
            text = rng.choice(["Yes.", "No", "", " \t", None, "so it is! ", "wait", "a. ", f"{rng.random()}.", f"{rng.random()}", "Straße?\n"])
            rows.append((conv, rng.choice([turn, turn, turn, turn // 2, None]), role, text))
    return rows + rows[:20] + [(3, 4, "user", "same.")] * 9 + [(7, 1, "assistant", "x" * 50_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_query_equals_sql(spark, tmp_path, seed):
    rows = talk(seed)
    spark.createDataFrame(rows, MESSAGES).withColumns({c: F.lit("clash") for c in ("task", "audit", "blank", "_conv", "a.b")}).write.parquet(f"{tmp_path}/conversations.parquet")
    assert counted(repair.op11_repair(spark, str(tmp_path))) == by_sql(repair.ORACLE_SQL["op11_repair"], conversations=(rows, MESSAGES))


@pytest.mark.parametrize("least", [1, 2, 7])
def test_repair_does_not_depend_on_blocks(spark, least):
    rows = talk(5, 25, 150)
    frame = spark.createDataFrame(rows, MESSAGES)
    assert counted(repair.repair_report(frame, repair.damaged(frame), least)) == by_sql(repair.ORACLE_SQL["op11_repair"], conversations=(rows, MESSAGES))


def test_repaired_messages_are_legal(spark):
    messages = repair.damaged(spark.createDataFrame(talk(3), MESSAGES))
    parts = repair.walked(repair.in_blocks(repair.marked(messages)))
    roles = defaultdict(str)
    for r in repair.repaired(messages, parts).collect():
        roles[r.conv_id] += r.role[0] if r.edit != "D" else ""
    assert len(roles) > 50 and all(re.fullmatch("(s?(ua)+)?", x) for x in roles.values())


def cheapest(codes):
    """Cost and audit by trying all audits in order of length of edits, without a queue."""
    best, todo = (10**9, ""), [(0, "", 0, 0)]
    while todo:
        cost, audit, place, state = todo.pop()
        if place == len(codes) and state in (0, 3):
            best = min(best, (cost, audit))
        if cost > min(best[0], 4 * len(codes)) or audit.endswith("III"):
            continue
        for letter, step, after, read in repair.arcs(codes[place] if place < len(codes) else None, state):
            todo.append((cost + step, audit + letter, place + read, after))
    return best


def test_solver_equals_full_search():
    rng = random.Random(8)
    for _ in range(300):
        codes = bytes(rng.choice([0, 1, 2, 3, 5, 6, 9]) for _ in range(rng.randrange(6)))
        assert repair.solved(codes) == cheapest(codes)


def test_repair_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], MESSAGES).write.parquet(f"{tmp_path}/conversations.parquet")
    assert repair.op11_repair(spark, str(tmp_path)).collect() == []


def ids_of(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    return [[*model.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def check_packing(rows, pieces, capacity=1024):
    """Every id of every row in one piece, gapless sequences without padding; repeated ids are told apart by their checksums."""
    wanted = Counter((i, tuple(ids)) for (i, _), ids in zip(rows, ids_of([t for _, t in rows])))
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    for doc in {i for i, _ in rows}:
        need = Counter()
        for (i, ids), n in wanted.items():
            if i == doc:
                need[len(ids)] += n * len(ids)
        assert Counter({k: sum(p.length for p in by_doc[doc] if p.doc_tokens == k) for k in need}) == need
        for p in by_doc[doc]:
            assert any(
                len(ids) == p.doc_tokens and zlib.crc32(np.asarray(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
                for i, ids in wanted if i == doc
            )
    for found in sequences.values():
        end = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == end and p.length > 0
            end += p.length
        assert end <= capacity and (end & (end - 1)) == 0
    return sequences


def odd_texts(seed):
    rng = random.Random(seed)
    words = ["the", "water", "\n\n", "  ", "don't", "Straße", "　", "12", "<|endoftext|>", "\x1c!", "\xa0", "日本", "é", "🙂"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 50, 400, 1500])))) for i in range(60)]
    return [*rows, (None, "no id"), (None, None), (100, None), (101, ""), rows[5], rows[5], (5, "other text of id five"), (102, "x" * 30_000), (103, "word " * 20_000)]


def test_packing_query(spark, tmp_path):
    rows = odd_texts(1)
    frame = spark.createDataFrame(rows, TEXTS).withColumns({c: F.lit("clash") for c in ("task", "length", "rest", "start", "a.b", "full")})
    frame.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    check_packing(rows, packing.op12_packing(spark, str(tmp_path)).collect())


def test_packing_of_lengths_that_never_fit(spark):
    ids = ids_of([" the" * 599])[0]
    assert len(ids) == 600
    rows = [(i, " the" * 599) for i in range(41)]
    found = check_packing(rows, packing.pack(spark.createDataFrame(rows, TEXTS), packing.public_tokenizer()).collect())
    assert sum(sum(p.length for p in s) == 1024 for s in found.values()) == 41 * 600 // 1024


def test_packing_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    assert packing.op12_packing(spark, str(tmp_path)).collect() == []


def test_chunks_have_the_ids_of_the_whole():
    encoder, rng = packing.Ids(packing.public_tokenizer()), random.Random(6)
    odd = [*packing.UNSURE, *" \n.!'aé1日🙂 ", "the", " the", "'s", "\u200b"]
    texts = [t or "" for _, t in odd_texts(2)] + ["".join(rng.choice(odd) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for _ in range(2):  # the second time all are known
        ids, ends = encoder.encode(pa.array([*texts, None]).slice(1))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [i[:-1] for i in ids_of([*texts[1:], ""])]


def test_fill_comes_closest():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 3) for _ in range(rng.randrange(1, 5))}
        room = rng.randrange(0, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        found = packing.fill(counts, room)
        assert sum(x * n for x, n in found.items()) == max(s for s in sums if s <= room) and all(n <= counts[x] for x, n in found.items())


def spelt(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randrange(7, 11))) for _ in range(40)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.choice([0, 5, 60])):
            word = stems[min(int(rng.expovariate(0.2)), 39)]
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at = rng.randrange(len(word))
                word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("abcdéÿÀ") + word[at:], word[:at] + rng.choice("abcdéÿÀ") + word[at + 1 :]])
            words.append(rng.choice([word, word, word.upper() if word.isascii() else word]))
        rows.append((i, rng.choice([" ", "-", "1"]).join(words)))
    return [*rows, (None, "abcabcabc abcabcab"), (None, None), (500, None), (501, ""), rows[3], rows[3], (502, "abcabca " * 5000), (503, "a" * 20_000)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spelling_query_equals_sql(spark, tmp_path, seed):
    rows = spelt(seed)
    spark.createDataFrame(rows, TEXTS).withColumns({c: F.lit("clash") for c in ("word", "run", "n", "a.b", "key")}).write.parquet(f"{tmp_path}/documents.parquet")
    found = counted(spelling.op13_spelling(spark, str(tmp_path)))
    assert len(found) > 100 and found == by_sql(spelling.ORACLE_SQL["op13_spelling"], documents=(rows, TEXTS))


def test_roots_follow_long_chains(spark):
    rows = spark.createDataFrame([(f"w{i}", f"w{i + 1}" if i < 40 else None) for i in range(41)], "word string, form string")
    assert {r.root for r in spelling.with_roots(rows).collect()} == {"w40"}


def test_spelling_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    assert spelling.op13_spelling(spark, str(tmp_path)).collect() == []
