"""Greedy one-to-one assignment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.workspace import saved

THRESHOLD, GAP = 0.45, 0.12


def assign(pairs: DataFrame, group: str, left: str, right: str, score: str, threshold: float = THRESHOLD) -> DataFrame:
    """The scored pairs taken greedily, best first, each side once in a group; ties go to the smaller left, then right.

    Whether a pair is taken depends on all better ones of its group, so a group's pairs are read in one task, in sorted
    order and as a stream: only the sides taken so far are held. Pairs below the threshold are dropped before the
    shuffle, and a group should be one document's or order's.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen_left, seen_right = None, set(), set()
        for b in batches:
            keep = []
            for g, x, y in zip(*[b.column(c).to_pylist() for c in (group, left, right)], strict=True):
                if g != at:
                    at, seen_left, seen_right = g, set(), set()
                ok = x not in seen_left and y not in seen_right
                keep.append(ok)
                if ok:
                    seen_left.add(x)
                    seen_right.add(y)
            yield b.filter(pa.array(keep, pa.bool_()))

    dealt = pairs.where(F.col(score) >= threshold).repartition(group).sortWithinPartitions(group, F.desc(score), left, right)
    return dealt.mapInArrow(take, pairs.schema)


#: Pairs of a group that one task may read.
SMALL = 10_000


def assign_all(pairs: DataFrame, group: str, left: str, right: str, score: str, threshold: float = THRESHOLD, small: int = SMALL) -> DataFrame:
    """The same as `assign`, for groups of any size, such as a document that holds a third of all pairs.

    A pair that is the best of both its sides is one that the greedy order takes, whatever else it takes before; so such
    pairs are found by two aggregations, taken all at once, and the pairs of their sides go. That is repeated while a
    group has more than `small` pairs; smaller ones are finished as streams. Every round takes a pair of each group left.
    Pairs that repeat whole are taken once; null sides are sides like others.
    """
    key = "pair_number"
    order = F.struct((-F.col(score)).alias("s"), F.col(left).alias("l"), F.col(right).alias("r"), F.col(key).alias("p"))
    rows = saved(pairs.where(F.col(score) >= threshold).withColumn(key, F.monotonically_increasing_id()))
    rows = saved(rows.withColumn("by_left", F.struct(group, left)).withColumn("by_right", F.struct(group, right)).withColumn("by_group", F.struct(group)))
    parts = []
    while True:
        big = saved(rows.groupBy("by_group").count().where(F.col("count") > small).select("by_group"))
        if big.isEmpty():
            break
        parts.append(assign(rows.join(big, "by_group", "left_anti").select(*pairs.columns), group, left, right, score, threshold))
        rows = rows.join(big, "by_group", "left_semi")
        best = [rows.groupBy(side).agg(F.min(order).alias("best")).select(F.col("best.p").alias(key)) for side in ("by_left", "by_right")]
        taken = saved(rows.join(best[0], key, "left_semi").join(best[1], key, "left_semi"))
        parts.append(taken.select(*pairs.columns))
        rows = saved(rows.join(taken.select("by_left"), "by_left", "left_anti").join(taken.select("by_right"), "by_right", "left_anti"))
    parts.append(assign(rows.select(*pairs.columns), group, left, right, score, threshold))
    return reduce(DataFrame.unionByName, parts)
