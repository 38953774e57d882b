"""Conversation repair against brute force over all lists of edits, and long conversations in blocks against short ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import repair
from quarry.llm.registry import ORACLES, QUERIES
from quarry.sources.tables import table

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def judged(rows):
    """Faults and the cheapest edits of one conversation, by trying all of them, cheapest first."""
    seen, bad, open_ = set(), [], []
    counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        bad.append(fault in ("blank", "duplicate"))
        open_.append(5 if fault == "truncated" else 0)
    front = {(0, "", "", ()): 0}
    done = []
    limit = 2 * len(rows) + 1
    while front:
        new = {}
        for (i, initials, audit, turns), cost in front.items():
            if cost > limit:
                continue
            if i == len(rows) and LEGAL.fullmatch(initials):
                done.append((cost, audit, turns))
            steps = []
            if i < len(rows):
                _, role, text = rows[i]
                steps.append((1, initials, "D", (), 2))
                if not bad[i]:
                    steps.append((1, initials + role[:1], "K", ((role, text),), open_[i]))
                    steps += [(1, initials + r[0], "R", ((r, text),), 1 + open_[i]) for r in ("user", "assistant")]
            steps += [(0, initials + r[0], "I", ((r, ""),), 5) for r in ("user", "assistant")]
            for step, found, letter, more, price in steps:
                if re.fullmatch(r"s?(ua)*u?", found) and len(found) - (found[:1] == "s") >= 0:
                    key = (i + step, found, audit + letter, turns + more)
                    new[key] = min(new.get(key, 1 << 30), cost + price)
        front = new
    cost, audit, turns = min(done)
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())


def by_rows(rows):
    """The rows of each conversation in the defined order, with nulls as one space."""
    found = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], " " if r[3] is None else r[3])):
        found.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    return found


def made(n, seed=5, longest=4):
    rng, out = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "s", None])
            out.append((c, rng.choice([t, t + 2, None]), role, rng.choice(["One.", "Two!", "no end", "", " \n", None, f"Is it {t}?", "é漢.\t"])))
    return out


def got(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[n] for n in names) for r in df.collect()}


def test_against_all_lists_of_edits(spark):
    rows = made(60)
    want = {c: judged(r) for c, r in by_rows(rows).items()}
    assert got(repair.digest(spark.createDataFrame(rows, SCHEMA).repartition(7))) == want


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_conversations_in_blocks(spark, monkeypatch, block):
    rows = made(40, seed=8) + [(None, 1, "user", "Q?"), (None, None, "assistant", "A."), (None, 2, "tool", "x")]
    want = {c: judged(r) for c, r in by_rows(rows).items()}
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "ROWS", 1)  # every conversation of more than one row is a long one
    assert got(repair.digest(spark.createDataFrame(rows, SCHEMA))) == want


def test_long_and_whole_conversations_are_alike(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", "No", f"T{t}.", ""])) for c in range(3) for t in range(rng.randint(200, 300))]
    df = spark.createDataFrame(rows, SCHEMA)
    want = got(repair.digest(df.coalesce(1)))
    monkeypatch.setattr(repair, "BLOCK", 16)
    monkeypatch.setattr(repair, "ROWS", 20)
    assert got(repair.digest(df)) == want and len(want) == 3
    pieces = repair.repair(df).collect()
    for c, row in want.items():
        mine = sorted((p for p in pieces if p.conv_id == c), key=lambda p: (p.part, p.pos))
        assert "".join(p.letters for p in mine) == row[-2]
        assert LEGAL.fullmatch("".join(t.role[0] for p in mine for t in p.turns))
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for p in mine for t in p.turns).encode()).hexdigest() == row[-1]


def damaged_by_force(rows):
    out = []
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            out += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    return out


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = {c: judged(r) for c, r in by_rows(damaged_by_force(rows)).items() if len(r) <= 5}
    found = got(QUERIES["op12_structure_repair"](spark, sf_dir))
    assert set(found) == {r[0] for r in rows} and len(want) > 5
    assert {c: found[c] for c in want} == want


def test_cases(spark):
    empty = hashlib.sha256(b"").hexdigest()
    nothing = spark.createDataFrame([], SCHEMA)
    assert repair.check(nothing).count() == 0 and repair.repair(nothing).count() == 0
    gone = next(n for n in range(100) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "All goes."), (None, None, None, None), (1000, 5, "user", "long " * 300000 + "."), (1000, 5, "user", "long " * 300000 + "."), (1000, 9, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("part", "pos", "whole", "cost", "kind", "code", "digest", "block"):
        df = df.withColumn(c, F.lit("clash"))
    found = got(repair.check(df))
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", empty)
    want = {c: judged(r) for c, r in by_rows(damaged_by_force(rows)).items()}
    assert found == {gone: found[gone]} | want


def test_query_gives_the_rows_of_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    cursor = con.execute(ORACLES["op12_structure_repair"])
    names = [d[0] for d in cursor.description]
    df = QUERIES["op12_structure_repair"](spark, sf_dir)
    assert df.columns == names
    assert sorted(map(tuple, df.collect())) == sorted(cursor.fetchall())
