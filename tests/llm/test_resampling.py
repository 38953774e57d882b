"""Importance resampling against brute force, by dictionaries of n-grams, and against SQL."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import resampling
from quarry.llm.registry import ORACLES, QUERIES
from quarry.sources.tables import table

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, longest):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)], len(words)


def by_force(docs, target, longest=1, buckets=10000, percent=10, least=20, seed=2024):
    def bucket(g):
        return zlib.crc32(g.encode()) % buckets

    s, t = collections.Counter(), collections.Counter()
    for _, x in docs:
        s.update(map(bucket, grams(x, longest)[0]))
    for x in target:
        t.update(map(bucket, grams(x, longest)[0]))
    out = []
    for d, x in docs:
        found, n = grams(x, longest)
        weight = 0
        if found:
            weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in map(bucket, found)) // len(found)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    could = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for r in out:
        r.append(None)
    for k, r in enumerate(could[: len(could) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


def made(n, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ünder", "ABC", "漢字", "x1"]
    return [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.choice([0, 1, 2, 15, 20, 30, 80])))) for i in range(n)]


@pytest.mark.parametrize(("longest", "buckets", "percent", "least"), [(1, 10000, 10, 20), (2, 50, 33, 1), (4, 1000, 100, 15), (3, 7, 1, 20)])
def test_against_brute_force(spark, longest, buckets, percent, least):
    docs, target = made(300), [x for _, x in made(20, seed=9)]
    how = {"longest": longest, "buckets": buckets, "percent": percent, "least": least}
    df = resampling.resample(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame([(x,) for x in target], "text string"), **how)
    assert got(df) == by_force(docs, target, **how)


def test_suffixes_are_sorted_and_share_what_they_say():
    rng = np.random.default_rng(1)
    ids, n = rng.integers(0, 3, 200), 200
    left = np.concatenate([np.arange(k, 0, -1) for k in (50, 1, 149)])
    order, common = resampling.suffixes(ids, left, 5)
    read = [tuple(ids[i : i + min(5, left[i])]) for i in order]
    assert read == sorted(read) and sorted(order.tolist()) == list(range(n))
    for a, b, c in zip(read, read[1:], common[1:].tolist(), strict=False):
        assert a[:c] == b[:c] and (c == min(len(a), len(b)) or a[c] != b[c])


def test_cases(spark):
    none, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("some words",)], "text string")
    assert resampling.resample(none, target).count() == 0
    docs = [(1, None), (2, ""), (3, "..."), (None, "a " * 25), (4, "long " * 200000), (5, "b " * 30), (5, "b " * 30), (5, "b " * 30)]
    df = spark.createDataFrame(docs, SCHEMA)
    for c in ("score", "rank", "weight", "bucket", "n", "salt", "at"):
        df = df.withColumn(c, F.lit("clash"))
    for percent in (0, 50, 100):
        assert got(resampling.resample(df, target, percent=percent)) == by_force(docs, ["some words"], percent=percent)
    assert got(resampling.resample(df, none)) == by_force(docs, [])
    assert {tuple(r) for r in resampling.draw(df, target, percent=100).select("doc_id", "rank").collect()} == {(d, "clash") for d in (None, 4, 5)}


def test_one_row_repeated_is_sorted_over_ranges(spark):
    docs = [(7, "a b c d e f g h i j k l m n o p q r s t")] * 3000 + [(8, "u " * 20)] * 5
    df = resampling.resample(spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame([("a b",)], "text string"), percent=100)
    assert sorted(r.rank for r in df.collect()) == list(range(1, 3006))


def test_query(spark, sf_dir):
    import duckdb

    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    want = by_force(docs, [r.text for r in table(spark, sf_dir, "benchmark").collect()])
    df = QUERIES["op13_importance_resampling"](spark, sf_dir)
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    found = sorted((tuple(r) for r in df.collect()), key=str)
    assert found == sorted(((d, n, w, s, r) for d, _, n, w, s, r in want), key=str)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert sorted(con.execute(ORACLES["op13_importance_resampling"]).fetchall(), key=str) == found
