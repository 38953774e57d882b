"""Relational operators that SQL has no word for: keep-best, division, interval and ladder joins, upserts, sampling."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def keep_best(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first by the order.

    With a struct of the order, it is an aggregate with partial results, so that a hot key is a row from each task; `order` must be ascending in the struct's sense.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key: the greatest by the columns of the order."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def owners_of_all(df: DataFrame, owner: str, member: str, members: list) -> DataFrame:
    """Relational division: owners that have every member."""
    return df.where(F.col(member).isin(*members)).groupBy(owner).agg(F.count_distinct(member).alias("n")).where(F.col("n") == len(set(members))).select(owner)


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs with the same key and left < right <= left + seconds.

    Time is cut into buckets of the interval's length: a left row meets its own and the next, so the join is on equal keys, and a hot key spreads over time.
    """
    micros = F.unix_micros(F.col(left_time).cast("timestamp"))
    size = seconds * 1_000_000
    at = F.floor(micros / size)
    l = left.withColumn("bucket", F.explode(F.array(at, at + 1)))
    r = right.withColumn("bucket", F.floor(F.unix_micros(F.col(right_time).cast("timestamp")) / size))
    after = F.unix_micros(r[right_time].cast("timestamp")) - F.unix_micros(l[left_time].cast("timestamp"))
    return l.join(r, (l[key] == r[key]) & (l["bucket"] == r["bucket"]) & (after > 0) & (after <= size)).drop("bucket")


def ladder_lookup(df: DataFrame, master: DataFrame, rungs: list[tuple[Column, Column]], df_key: str, master_key: str) -> DataFrame:
    """For each row the master row of the first rung whose expressions agree: df_key, master_key and rung (from 1).

    On one rung the least master key wins. Every rung is an equi-join.
    """
    hits = [df.join(master, a == b).select(df[df_key], master[master_key], F.lit(k).alias("rung")) for k, (a, b) in enumerate(rungs, 1)]
    return reduce(DataFrame.unionByName, hits).groupBy(df_key).agg(F.min(F.struct("rung", master_key)).alias("best")).select(df_key, F.col(f"best.{master_key}").alias(master_key), F.col("best.rung").alias("rung"))


def update_from(df: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows with columns replaced where an update has a value."""
    new = updates.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    return df.join(new, key, "left").select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def upsert_last(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Current rows overwritten by the last change of each key."""
    last = latest(changes, [key], order)
    return current.join(last.select(key), key, "left_anti").unionByName(last.select(*current.columns))


def insert_ignore(current: DataFrame, rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Current rows and, for keys they lack, the first new row."""
    return current.unionByName(keep_best(rows, [key], *order).join(current.select(key), key, "left_anti").select(*current.columns))


def hash_quota(df: DataFrame, key: str, group: str, quota: int, seed: str) -> DataFrame:
    """From each group the `quota` rows of least SHA-256 of seed and key. The rank is pruned before the shuffle."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order, key))
    return df.withColumn("rank", rank).where(F.col("rank") <= quota)


def round_robin(df: DataFrame, key: str, group: str, total: int, seed: str) -> DataFrame:
    """`total` rows, one from each group in turn (groups in order, rows by hash)."""
    ranked = hash_quota(df, key, group, total, seed)
    return ranked.orderBy("rank", group).limit(total)


def page(df: DataFrame, offset: int, size: int, *order: Column | str) -> DataFrame:
    """A page of rows with the count of all."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(size).join(total, how="cross")  # one row


def probe(df: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """At most `most` rows, each with whether there were more: one row more than wanted is fetched."""
    some = df.orderBy(*order).limit(most + 1)
    n = some.agg((F.count("*") > most).alias("truncated"))
    return some.orderBy(*order).limit(most).join(n, how="cross")  # one row


#: Distinct values of a group that are put in order in one task.
ORDERED = 100_000
DIGIT = 16
_LEAST = -(1 << 63)


@F.pandas_udf(LongType())
def _bits(s: pd.Series) -> pd.Series:
    """The bits of doubles as whole numbers in the order of their values; Spark has no function for a double's bits."""
    x = s.to_numpy(np.float64)
    bits = x.view(np.int64)
    signed = np.where(bits < 0, -(bits & np.int64((1 << 63) - 1)), bits)
    return pd.Series(np.where(np.isnan(x), np.int64((1 << 63) - 1), signed))


def ordered_bits(c: Column, kind: str) -> Column:
    """A 64-bit whole number in the order of a column's values, -infinity to infinity, then NaN. Equal values have equal numbers."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return c.cast("long")
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_date(c).cast("long") if kind == "date" else F.unix_micros(c.cast("timestamp"))
    if kind.startswith("decimal(") and int(kind[8:].split(",")[0]) <= 18:
        return (c * F.lit(10 ** int(kind[:-1].split(",")[1])).cast("decimal(19,0)")).cast("long")
    if kind not in ("float", "double"):
        raise ValueError(f"values of type {kind} have no order by bits")
    return _bits(c.cast("double"))


def nearest_rank(df: DataFrame, group: list[str], column: str, q: float, ordered: int = ORDERED) -> DataFrame:
    """The value at place floor((n - 1) * q) of the sorted numbers of each group: exact; nulls come first, NaN last.

    Equal values are counted first. Groups of at most `ordered` values are put in order. In larger ones the place is found
    digit by digit: values are whole numbers of 64 bits in the same order, and four counts, each of at most 65,536 digits a
    group, leave one value; no task gets a group's values, however they are spread.
    """
    kind = dict(df.dtypes)[column]
    counts = df.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], F.col(column).alias("v")).groupBy(*[f"g{i}" for i in range(len(group))], "v").agg(F.count("*").alias("n"))
    keys = [f"g{i}" for i in range(len(group))]
    own = F.struct(*keys) if keys else F.struct(F.lit(1).alias("one"))
    counts = counts.select(own.alias("g"), "v", "n")
    nulls = F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0))
    sizes = counts.groupBy("g").agg(F.count("*").alias("values"), (F.floor((F.sum("n") - 1) * q)).alias("target"), nulls.alias("nulls"))
    small = counts.join(sizes.where(F.col("values") <= ordered), "g")
    before = F.sum("n").over(Window.partitionBy("g").orderBy("v")) - F.col("n")
    found = small.withColumn("before", before).where((F.col("before") <= F.col("target")) & (F.col("target") < F.col("before") + F.col("n"))).select("g", "v")
    many = sizes.where(F.col("values") > ordered)
    large = counts.where(F.col("v").isNotNull()).join(many.select("g"), "g", "left_semi").withColumn("bits", ordered_bits(F.col("v"), kind).bitwiseXOR(F.lit(_LEAST)))
    state = many.where(F.col("target") >= F.col("nulls")).select("g", (F.col("target") - F.col("nulls")).alias("target"), F.lit(0).cast("long").alias("prefix"))
    found = found.unionByName(many.where(F.col("target") < F.col("nulls")).select("g", F.lit(None).cast(kind).alias("v")))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        above = F.shiftrightunsigned("bits", shift + DIGIT) if shift + DIGIT < 64 else F.lit(0).cast("long")
        inside = large.withColumn("above", above).join(state, "g").where(F.col("above") == F.col("prefix"))
        digits = inside.groupBy("g", F.shiftrightunsigned("bits", shift).alias("digit")).agg(F.sum("n").alias("n"), F.first("target").alias("target"))
        before = F.sum("n").over(Window.partitionBy("g").orderBy("digit")) - F.col("n")
        hit = digits.withColumn("before", before).where((F.col("before") <= F.col("target")) & (F.col("target") < F.col("before") + F.col("n")))
        state = hit.select("g", (F.col("target") - F.col("before")).alias("target"), F.col("digit").alias("prefix"))
    exact = large.join(state.select("g", F.col("prefix").alias("bits")), ["g", "bits"]).groupBy("g").agg(F.min("v").alias("v"))
    return found.unionByName(exact).select(*[F.col(f"g.g{i}").alias(g) for i, g in enumerate(group)], F.col("v").alias("quantile"))
