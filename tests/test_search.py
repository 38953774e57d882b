"""The inverted index against scoring every row, with ties, pruned zones, hot tokens and rows of nothing."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quarry.functions import scoring as sc
from quarry.functions import text as tx
from quarry.operators import search


def made(n, seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    return [(i if i % 50 else None, rng.choice([None, "", " ".join(["hot", *rng.choices(words, k=rng.randint(0, 9))])]), rng.choice(["a", "b", "c"]), rng.randint(0, 40), rng.random() < 0.2) for i in range(n)]


SCHEMA = "id long, text string, kind string, size int, sure boolean"


def score(f, ratio):
    near = sc.closeness(f.nearest("size", 12.0) * 40.0, F.lit(480.0))
    return sc.rounded(sc.total(sc.weight(f.may_equal("kind", "b"), 0.2), 0.5 * ratio, 0.2 * near, sc.weight(f.sure, 0.1)), 4)


def by_force(rows, tokens, k):
    out = []
    for i, text, kind, size, sure in rows:
        have = set((text or "").split())
        ratio = len(have & set(tokens)) / max(len(set(tokens)), 1)
        near = 1 - min(abs(size - 12) * 40 / 100, 1)
        out.append((i, round((0.2 * (kind == "b") + 0.5 * ratio + 0.2 * near + 0.1 * sure) * 10000 + 1e-7) / 10000))
    return sorted(out, key=lambda r: (-r[1], r[0] is not None, r[0] or 0))[:k]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = made(1500)
    df = spark.createDataFrame(rows, SCHEMA)
    features = {"kind": F.col("kind"), "size": F.col("size"), "sure": F.col("sure")}
    return rows, replace(search.build(df, str(tmp_path_factory.mktemp("index")), F.col("id"), tx.index_tokens(F.col("text")), features, ["kind", "size"], buckets=8, zones=24), few=0)


@pytest.mark.parametrize("k", [1, 10, 200, 5000])
@pytest.mark.parametrize("tokens", [["w1", "w2", "w3"], ["hot"], ["nowhere"], [], ["w1", "w1", "hot"]])
def test_the_result_is_that_of_scoring_every_row(built, tokens, k):
    rows, index = built
    assert [tuple(r) for r in replace(index, few=10**6).search(tokens, score, k).collect()] == [tuple(r) for r in index.search(tokens, score, k).collect()]
    got = [tuple(r) for r in index.search(tokens, score, k).collect()]
    want = by_force(rows, tokens, k)
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1.1e-4)
    least = want[-1][1]
    assert {i for i, s in got if s > least + 2e-4} == {i for i, s in want if s > least + 2e-4}


def test_zones_that_cannot_reach_the_result_are_not_read(built):
    _, index = built
    bounds = {b.zone: b.bound for b in index.bounds(["w1", "w2"], score).collect()}
    exact = index.scored(["w1", "w2"], score).join(index.table("rows").select("ref", "zone"), "ref").groupBy("zone").agg(F.max("score").alias("most")).collect()
    assert all(bounds[r.zone] >= r.most for r in exact) and len(bounds) > 10
    bounds = {b.zone: b.bound for b in index.bounds(["nowhere"], score).collect()}
    tenth = sorted((r.score for r in index.scored(["nowhere"], score).collect()), reverse=True)[9]
    assert sum(b < tenth for b in bounds.values()) > 10
    plan = index._of("postings", ["w1"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(token,w1)" in plan


def test_an_index_is_built_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", "k", 1, True)], SCHEMA)
    how = (str(tmp_path / "i"), F.col("id"), tx.index_tokens(F.col("text")), {"kind": F.col("kind")}, [])
    search.opened(df, *how)
    again = search.opened(spark.createDataFrame([(2, "c", "k", 1, True)], SCHEMA), *how)
    assert [r.id for r in again.table("rows").collect()] == [1]
    assert search.coverage(again, 4).collect()[0].asDict() == {"indexed": 1, "coverage": 0.25, "missing": 3, "without_tokens": 0, "postings": 2, "vocabulary": 2}


def test_postings_are_written_where_their_rows_are_read(spark, tmp_path):
    """No posting is sent to another task or sampled, and each file is in the order of its tokens' hashes."""
    df = spark.createDataFrame(made(3000), SCHEMA)
    store, writers = spark._jsparkSession.sharedState().statusStore(), spark.conf.get(search.WRITERS, "0")
    before = store.executionsCount()
    index = search.build(df, str(tmp_path / "i"), F.col("id"), tx.index_tokens(F.col("text")), {"kind": F.col("kind")}, ["kind"], buckets=4, zones=6)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(before, store.executionsCount())]
    own = [p for p in plans if "InsertIntoHadoopFsRelationCommand" in p and f"{tmp_path}/i/postings," in p.split("InsertIntoHadoopFsRelationCommand")[-1]]
    assert len(own) == 1 and "Exchange" not in own[0] and spark.conf.get(search.WRITERS, "0") == writers
    files = index.table("postings").withColumn("file", F.input_file_name()).groupBy("file").agg(F.collect_list("key").alias("keys"), F.count_distinct("bucket").alias("n")).collect()
    assert len(files) >= 4 and all(f.n == 1 and f.keys == sorted(f.keys) for f in files)
    assert index.table("postings").count() == sum(len(set((r[1] or "").split())) for r in made(3000))


def test_words_are_split_where_a_letter_follows_a_digit(spark):
    df = spark.createDataFrame([("A1b2 12kg x9",), ("plain 12 w3",), (None,)], "t string")
    assert [set(r[0] or []) for r in df.select(tx.index_tokens(F.col("t"))).collect()] == [{"a1b2", "a1", "b2", "12kg", "12", "kg", "x9"}, {"plain", "12", "w3"}, set()]


def test_an_index_of_nothing(spark, tmp_path):
    index = search.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "i"), F.col("id"), tx.index_tokens(F.col("text")), {"kind": F.col("kind")}, ["kind"])
    assert index.search(["a"], lambda f, ratio: ratio, 5).count() == 0
    with pytest.raises(ValueError):
        search.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "j"), F.col("id"), tx.index_tokens(F.col("text")), {"zone": F.col("kind")}, [])


def test_chinese_parts_are_tokens(spark):
    df = spark.createDataFrame([("客户订单金额统计 Top10",), ("单金",), ("abc",)], "t string")
    have = [set(r[0]) for r in df.select(tx.index_tokens(F.col("t"))).collect()]
    asked = spark.range(1).select(tx.question_tokens(F.lit("订单金额 top10"))).first()[0]
    assert asked == ["订单金额", "订单", "单金", "金额", "top10"]
    assert [len(have[i] & set(asked)) for i in range(3)] == [5, 1, 0]


def test_relevance(spark):
    df = spark.createDataFrame([("Order_Head", "销售 order", None, ["orders"], None)], "n string, l string, d string, k array<string>, x string")
    got = df.select(
        sc.table_relevance(F.col("n"), F.col("l"), F.col("d"), ["ORDER", "50%"]), sc.field_relevance(F.col("d"), F.col("n"), F.col("l"), F.lit("_"), ["_h"]),
        sc.module_relevance(F.lit("Show ORDERS of Order_Head"), F.col("n"), F.col("x"), F.lit("show"), F.col("k"), F.array(F.col("x"))),
        sc.template_relevance(F.lit(True), F.lit(True), F.lit(0.5), F.lit(1.0), F.lit(0.45), F.lit(4), F.lit(3)), sc.family_relevance(F.lit(True), F.lit(False), F.lit(0.25)),
        sc.config_relevance(F.lit(""), F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit("unknown"), F.lit(None).cast("string")), sc.config_relevance(F.lit("P1"), F.lit(0.5), F.lit("C"), F.lit("die"), F.lit("x")),
    ).first()
    assert list(got) == [95, 40, 15, 1.0, 0.5, 0.45, 0.975]
