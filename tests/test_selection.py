"""Assignment by rounds of best pairs against the greedy order, and exact quantiles by digits."""

import math
import random
from datetime import date, datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import relational as op
from quarry.operators.matching import assign, assign_all


def greedy(rows, threshold=0.45):
    taken, left, right = [], set(), set()
    for g, x, y, s in sorted(rows, key=lambda r: (-r[3], r[1] is not None, r[1] or 0, r[2] is not None, r[2] or 0)):
        if s >= threshold and (g, x) not in left and (g, y) not in right:
            left.add((g, x)), right.add((g, y)), taken.append((g, x, y, s))
    return sorted(taken, key=str)


SCHEMA = "g string, x long, y long, s double"


@pytest.mark.parametrize("small", [0, 3, 50, 10**6])
def test_rounds_give_the_greedy_order(spark, small):
    rnd = random.Random(small)
    rows = [(g, rnd.choice([*range(12), None]), rnd.randrange(14), rnd.choice([0.3, 0.45, 0.5, 0.9, round(rnd.random(), 2)])) for g in ("a", "b", None) for _ in range(70)] + [("one", 1, 1, 0.9)]
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in assign_all(df, "g", "x", "y", "s", small=small).collect()), key=str) == greedy(rows)
    assert assign_all(df.limit(0), "g", "x", "y", "s", small=small).count() == 0


def test_a_group_of_100000_pairs_is_spread(spark):
    rng = np.random.default_rng(2)
    scores = rng.integers(0, 5000, (330, 310)) / 5000
    rows = [("hot", i, j, float(scores[i, j])) for i in range(330) for j in range(310)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert df.count() > 100_000
    assert sorted((tuple(r) for r in assign_all(df, "g", "x", "y", "s", small=2000).collect()), key=str) == greedy(rows)


def test_a_chain_is_finished_as_a_stream(spark):
    rows = [("c", k // 2 + (k % 2), k // 2, 1 - k / 1000) for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, assign_all(df, "g", "x", "y", "s", small=390).collect()), key=str) == greedy(rows)
    assert sorted(map(tuple, assign(df, "g", "x", "y", "s").collect()), key=str) == greedy(rows)


def test_bits_keep_the_order_of_numbers(spark):
    rng = np.random.default_rng(5)
    odd = [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 2.0**-1022, np.nextafter(2.0**-1022, 0), 1.7976931348623157e308, 1e300]
    powers = [p for e in range(-1074, 1024) for p in (2.0**e, np.nextafter(2.0**e, 0), np.nextafter(2.0**e, math.inf), -(2.0**e))]
    any_ = rng.integers(-(1 << 63), (1 << 63) - 1, 20000).view(np.float64)
    values = np.array([*odd, *powers, *any_[~np.isnan(any_)]], np.float64)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = np.array([r[0] for r in df.select(op.ordered_bits(F.col("v"), "double")).collect()])
    bits = values.view(np.int64)
    want = np.where(bits < 0, -(bits & ((1 << 63) - 1)), bits)
    assert (got == want).all()
    assert spark.sql("select double('nan') v").select(op.ordered_bits(F.col("v"), "double")).first()[0] == (1 << 63) - 1


@pytest.mark.parametrize(
    ("kind", "values"),
    [
        ("long", [-(1 << 63), (1 << 63) - 1, 0, -1, 1, 5, None]), ("int", [3, -3, None, 7, 0]), ("decimal(10,2)", [Decimal("1.25"), Decimal("-3.10"), None, Decimal("0.01")]),
        ("date", [date(2024, 1, 2), date(1960, 5, 1), None]), ("timestamp", [datetime(2024, 1, 2, 3), datetime(1970, 1, 1), None]), ("float", [1.5, -2.5, None, 0.25]),
    ],
)
def test_quantiles_of_other_types(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    known = [None] * values.count(None) + sorted(v for v in values if v is not None)
    for q in (0.0, 0.4, 1.0):
        for ordered in (0, 1000):
            assert [r.quantile for r in op.nearest_rank(df, [], "v", q, ordered).collect()] == [known[int((len(known) - 1) * q)]]
    with pytest.raises(ValueError):
        op.nearest_rank(spark.createDataFrame([("a",)], "v string"), [], "v", 0.5)


def test_outliers_do_not_put_a_group_in_one_task(spark):
    rng = np.random.default_rng(7)
    values = [*rng.normal(size=30000).tolist(), 1e300, -math.inf, math.inf, math.nan]
    df = spark.createDataFrame([("hot", float(v)) for v in values], "g string, v double")
    for q in (0.1, 0.5, 0.99):
        got = op.nearest_rank(df, ["g"], "v", q, ordered=100).collect()
        assert [r.quantile for r in got] == [sorted(values[:-1])[int((len(values) - 1) * q)]]
    assert math.isnan(op.nearest_rank(df, ["g"], "v", 1.0, ordered=100).first().quantile)
    # What is put in order are counts of digits, never the group's values.
    digits = df.select(F.shiftrightunsigned(op.ordered_bits(F.col("v"), "double").bitwiseXOR(F.lit(-(1 << 63))), 48).alias("d")).distinct().count()
    assert digits < len(values) / 20
