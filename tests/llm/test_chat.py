"""Chat formatting: what is read back is what went in, for any text, whole or in pieces."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, turns
from quarry.llm.chat import CHAT, Template
from quarry.llm.registry import ORACLES, QUERIES
from quarry.sources.tables import table

SCHEMA = "conv_id long, turn long, role string, text string"
PARTS = ["</s>", "[INST]", "[/INST]", "<s>", "<<SYS>>", "\n<</SYS>>\n", "<|role|>", "<|text|>", "<|end|>", "\\", "\\0\\", "\\\\", "<", "[", "é", " ", "\n", "s>", "INST]", "7", "word"]


def made(n, seed=1, longest=9):
    rng = random.Random(seed)
    return [(c, rng.choice([t, t, 3, None]), rng.choice(["user", "assistant", "system", "tool", "<s>", None]), rng.choice([None, "", "".join(rng.choices(PARTS, k=rng.randint(1, 12)))]))
            for c in range(n) for t in range(rng.randint(1, longest))]


def by_force(rows):
    found, out = {}, {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        found.setdefault(c, []).append((r or "", x or ""))
    for c, said in found.items():
        taught = "".join(x for r, x in said if r == "assistant")
        state, illegal = "start", -1
        legal = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
        for i, (r, _) in enumerate(said):
            if r in legal[state]:
                state = r
            elif illegal < 0:
                illegal = i
        text = "".join(f"{r}\n{x}\n" for r, x in said)
        out[c] = (len(said), hashlib.sha256(text.encode()).hexdigest(), len(taught), hashlib.sha256(taught.encode()).hexdigest(), illegal < 0 and state == "assistant", illegal)
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid, r.first_illegal) for r in df.collect()}


def test_texts_come_back():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 10)))
        safe = CHAT.escape(text)
        assert CHAT.unescape(safe) == text and not any(c in safe for c in CHAT.controls)
        said = [(rng.choice(["user", "assistant", "tool", text]), "".join(rng.choices(PARTS, k=3))) for _ in range(4)]
        segments = CHAT.segments(said)
        assert CHAT.read("".join(s["text"] for s in segments)) == said
        assert [CHAT.unescape(s["text"]) for s in segments if s["loss"]] == [x for r, x in said if r == "assistant"]


def test_segments():
    assert CHAT.segments([("system", "S"), ("user", "<s>"), ("assistant", "A"), ("tool", "T")]) == [
        {"text": "<<SYS>>\nS\n<</SYS>>\n[INST] \\4\\ [/INST]\n<s> ", "loss": False}, {"text": "A", "loss": True}, {"text": " </s>\n<|role|>tool<|text|>T<|end|>\n", "loss": False},
    ]


@pytest.mark.parametrize("marks", [{"user": ("aba", "x")}, {"user": ("a b", "x")}, {"user": ("\\", "x")}, {"user": ("12", "x")}, {"user": ("a", "a")}, {"user": (" a", "x")}, {"user": ("q", "x"), "bot": ("qr", "y")}])
def test_templates_that_could_not_be_read_are_refused(marks):
    with pytest.raises(ValueError):
        Template(marks, ("<r>", "<t>", "<e>"), {"start": {}}, frozenset(), frozenset())


def test_whole_conversations(spark):
    rows = made(80)
    assert got(chat.digest(spark.createDataFrame(rows, SCHEMA).repartition(5))) == by_force(rows)


@pytest.mark.parametrize("piece", [1, 4])
def test_long_conversations_in_pieces(spark, monkeypatch, piece):
    rows = made(20, seed=6, longest=60) + [(None, 0, "user", "q"), (None, 1, "assistant", "a")]
    monkeypatch.setattr(chat, "ROWS", 24)
    monkeypatch.setattr(chat, "PIECE_ROWS", piece)
    df = spark.createDataFrame(rows, SCHEMA)
    assert chat.formatted(df).where("NOT whole").count() > 20
    assert got(chat.digest(df)) == by_force(rows)


def test_cases(spark):
    assert chat.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.conv_id for r in chat.check(spark.createDataFrame([], SCHEMA)).collect()] == [-1]
    rows = [(7, 0, "user", "long " * 300000), (7, 1, "assistant", "long " * 700000), (8, 1, "user", "twice"), (8, 1, "user", "twice"), (9, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("part", "pos", "whole", "segments", "moves", "said", "from"):
        df = df.withColumn(c, F.lit("clash"))
    assert got(chat.digest(df)) == by_force(rows)


def test_an_order_that_splits_one_conversation(spark):
    rows = [(5, t, "user", f"t{t}") for t in range(4000)]
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(merge)
    spark.conf.set(merge, "false")  # ranges as small as these would be read by one task
    df = turns.in_order(spark.createDataFrame(rows, SCHEMA).repartition(6)).withColumn("p", F.spark_partition_id())
    got = df.collect()
    spark.conf.set(merge, was)
    assert len({r.p for r in got}) > 1 and [r.turn for r in got] == list(range(4000))


def test_query(spark, sf_dir):
    import duckdb

    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()] + [(c, t, r, x) for c, t, r, x in chat.FORGED]
    df = QUERIES["op11_chat_formatting"](spark, sf_dir)
    found = {r.conv_id: r.asDict() for r in df.collect()}
    want = by_force(rows)
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["valid"]) for c, r in found.items()} == {c: w[:5] for c, w in want.items()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    cursor = con.execute(ORACLES["op11_chat_formatting"])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert {r["conv_id"]: r for r in (dict(zip(names, r, strict=True)) for r in cursor.fetchall())} == found
