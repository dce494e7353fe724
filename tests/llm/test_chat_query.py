"""The registered chat query against its SQL, on conversations with nested, partial, repeated and cross-conversation quotations."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from hitweave.llm import chat

TALK = "conv_id long, turn long, role string, text string"


def against_sql(spark, rows, folder):
    frame = spark.createDataFrame(rows, TALK).withColumns({c: F.lit("clash") for c in ("message_id", "position", "own", "k", "head", "depth", "copies")})
    frame.write.parquet(str(folder / "conversations.parquet"))
    found = chat.op9_chat(spark, str(folder))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT conv_id, turn, role, text FROM '{folder}/conversations.parquet/*.parquet'")
    expected = db.execute(chat.ORACLE_SQL["op9_chat"])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(found.columns)
    made = found.select(*columns).collect()
    assert Counter(map(tuple, made)) == Counter(expected.fetchall())
    return made


@pytest.mark.parametrize("seed", range(3))
def test_links_threads_and_depths_equal_sql(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows, said = [], []
    for conv in range(25):
        for turn in range(rng.randrange(1, 9)):
            own = [f"C{conv}  line {rng.randrange(60)} of it" for _ in range(rng.randrange(1, 6))] + ["A common line"] * (turn % 3 == 0)
            text = "\n".join(own[:2]) + "\n\n" + "\n".join(own[2:])
            if said and rng.random() < 0.6:
                other = rng.choice(said[-20:] if rng.random() < 0.8 else said)
                a = rng.randrange(len(other))
                part = other[a : a + rng.randrange(1, 4)]
                part = [" ".join(part)] if rng.random() < 0.2 else part
                mark = rng.choice(["> ", ">", "> > "])
                text = rng.choice(["", "On Monday\tsomebody wrote:\n", "x" * 300 + " wrote:\n"]) + "\n".join(mark + s.upper() for s in part) + ("\n> A common line" if rng.random() < 0.3 else "") + "\n" + text
            rows.append((conv, turn, rng.choice(["user", "assistant"]), text))
            said.append(own)
    rows += [rows[3], rows[3], rows[40]]
    found = against_sql(spark, rows, tmp_path)
    assert {r.link for r in found} == {"root", "order", "quote"} and max(r.depth for r in found) > 3
    by = {r.message_id: r for r in found}
    assert any(by[r.parent_id].conv_id != r.conv_id for r in found if r.link == "quote")
    assert all(r.thread_id == by[r.parent_id].thread_id for r in found if r.parent_id)


def test_odd_messages(spark, tmp_path):
    long = "\n".join(f"line {i}" for i in range(3000))
    rows = [
        (1, 0, "user", None), (1, 1, "user", ""), (1, 1, "user", ""), (1, None, None, "> line 7\nlast"), (1, 2, "user", long), (1, 3, "user", "> line 8\n> line 9\nyes"),
        (1, 4, "user", ">" * 500 + " line 8\n" + "> \n" * 50 + "no"), (2, 0, "user", "> line 2999"), (0, 0, "user", "> line 2999"), (1, 2, "user", long),
    ]
    found = {(r.conv_id, r.turn): r for r in against_sql(spark, rows, tmp_path)}
    whole = found[1, 2].message_id
    assert found[1, 3].parent_id == whole and found[1, 3].link == "quote" and found[2, 0].parent_id == whole and found[2, 0].thread_id == found[1, 0].message_id
    assert found[1, None].parent_id == whole and found[1, None].position == 7 and found[0, 0].link == "root"
    empty = tmp_path / "empty"
    empty.mkdir()
    assert against_sql(spark, [], empty) == []


def test_null_conversations_stay_apart(spark):
    rows = spark.createDataFrame([(None, 0, "user", "a line of words"), (None, 1, "user", "> a line of words\nso"), ("~", 0, "user", "> a line of words\nno")], "conv_id string, turn long, role string, text string")
    found = chat.conversations(rows).collect()
    assert [r.link for r in found] == ["root"] * 3 and all(r.depth == 0 and r.thread_id == r.message_id for r in found)
    assert sorted(r.position for r in found) == [0, 0, 1]
