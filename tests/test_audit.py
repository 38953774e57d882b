"""One-scan audits against counting and sorting every row."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators.audit import Finding, audit, repeated


@pytest.mark.parametrize("most", [1, 4, 10, 1000])
def test_counts_and_first_rows(spark, most):
    rnd = random.Random(most)
    rows = [(rnd.choice([None, *range(40)]), rnd.choice(["x", "y", None]), rnd.randint(0, 9)) for _ in range(700)]
    df = spark.createDataFrame(rows, "finding int, n string, v int").repartition(9)
    findings = [Finding("low", "info", F.col("v") < 3, F.col("n") == "x"), Finding("x", "warning", F.col("n") == "x"), Finding("never", "info", F.col("v") > 99), Finding("rare", "info", F.col("v") == 5, least=10_000)]
    got = {r.finding: r for r in audit(df, findings, {"a": F.col("finding")}, {"key": F.col("finding"), "v": F.col("v")}, most).collect()}
    assert set(got) == {"low", "x"}
    low = sorted(((a, v, n == "x") for a, n, v in rows if v < 3), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert [(s.key, s.v, s.mendable) for s in got["low"].samples] == low[:most]
    assert (got["low"].n, got["low"].mendable, got["low"].severity) == (len(low), sum(m for *_, m in low), "info")
    assert got["x"].n == sum(n == "x" for _, n, _ in rows) and got["x"].mendable == 0
    assert audit(df.limit(0), findings, {"a": F.col("v")}, {"key": F.col("v")}).count() == 0
    with pytest.raises(ValueError):
        audit(df, findings * 2, {"a": F.col("v")}, {"key": F.col("v")})


def test_the_table_is_read_once_and_only_few_rows_move(spark):
    df = spark.range(0, 5000, 1, 8).withColumn("v", F.col("id") % 7)
    out = audit(df, [Finding("a", "info", F.col("v") == 1), Finding("b", "info", F.col("v") > 1)], {"id": F.col("id")}, {"id": F.col("id")}, 3)
    assert "Range" not in out._jdf.queryExecution().executedPlan().toString()  # the scan is done, its few rows are kept
    assert {r.finding: [s.id for s in r.samples] for r in out.collect()} == {"a": [1, 8, 15], "b": [2, 3, 4]}


def test_repeated_keys(spark):
    df = spark.createDataFrame([("a", "t1"), ("a", "t1"), ("b", "t1"), ("b", "t2"), (None, "t1"), (None, "t2"), ("c", None), ("c", "t3"), *(("d", f"o{k:02}") for k in range(15))], "k string, o string")
    got = {r["key"]: (r["n"], r["owners"], r["first"]) for r in repeated(df, F.col("k"), F.col("o"), 3).collect()}
    assert got == {"b": (2, 2, ["t1", "t2"]), "c": (2, 2, [None, "t3"]), "d": (15, 15, ["o00", "o01", "o02"])}
