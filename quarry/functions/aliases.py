"""The longest known alias inside a text, by an automaton over all aliases that reads each text once.

The automaton (Aho-Corasick) is made once in each task from the alias list, which
is sent to the executors once; a list of more than `MOST` aliases is
refused. Among the aliases that a text contains the longest wins, then the first
in the list's order.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

MOST = 1_000_000


def _automaton(aliases: list[str]) -> ahocorasick.Automaton:
    """Over the aliases, each with its length and place; of equal ones the first counts."""
    a = ahocorasick.Automaton()
    for i, alias in enumerate(aliases):
        if alias and alias not in a:
            a.add_word(alias, (len(alias), -i))
    if len(a):
        a.make_automaton()
    return a


def longest_alias(spark: SparkSession, aliases: list[str]):
    """A function of a text column: the place in the list of the longest alias that the text contains, null if it contains none."""
    if len(aliases) > MOST:
        raise ValueError(f"{len(aliases)} aliases are too many to send to each executor")
    sent = spark.sparkContext.broadcast(aliases)

    @F.pandas_udf(IntegerType())
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = _automaton(sent.value)
        for texts in batches:
            yield pd.Series([-max(((hit[1][0], hit[1][1]) for hit in a.iter(t)), default=(0, 1))[1] if t and len(a) else -1 for t in texts], dtype="int32")

    def found(c: Column) -> Column:
        at = find(c)
        return F.when(at >= 0, at)

    return found


def resolve(rows: DataFrame, text: Column, normalised: Column, catalogue: DataFrame, rules: tuple[tuple[str, str], ...], generic: frozenset[str], fallback: tuple[str, str, str] | None = None) -> DataFrame:
    """The rows with canonical, display, matched and method: exact alias, then the first rule that fits, then the longest alias inside, then the fallback.

    catalogue: canonical, display, alias, normalised, in the order of `place`; aliases of one character are left out. rules:
    (pattern, canonical); those of canonicals that aren't in the catalogue are left out. generic aliases count only exactly.
    fallback: (pattern, canonical, matched). A text that is null or without characters has no result.
    """
    spark = rows.sparkSession
    entries = catalogue.where(F.length("normalised") >= 2).select("canonical", "display", "alias", "normalised", "place").orderBy(F.desc(F.length("normalised")), "place").limit(MOST + 1).collect()
    inside = [e for e in entries if e.alias not in generic]
    shown: dict[str, str] = {}
    for e in sorted(entries, key=lambda e: e.place):
        shown.setdefault(e.canonical, e.display)
    schema = "x_alias string, x_normalised string, x_canonical string, x_display string, x_at int"
    first: dict[str, tuple] = {}
    for e in entries:
        first.setdefault(e.normalised, (e.alias, e.normalised, e.canonical, e.display, 0))
    exact = F.broadcast(spark.createDataFrame(list(first.values()) or [], schema)).select("x_normalised", F.struct("x_canonical", "x_display", F.col("x_alias").alias("matched"), F.lit("exact").alias("method")).alias("exact"))
    listed = F.broadcast(spark.createDataFrame([(e.alias, e.normalised, e.canonical, e.display, i) for i, e in enumerate(inside)], schema))
    listed = listed.select("x_at", F.struct("x_canonical", "x_display", F.col("x_alias").alias("matched"), F.lit("contained_alias").alias("method")).alias("inside"))
    answer = lambda canonical, matched, method: F.struct(F.lit(canonical).alias("x_canonical"), F.lit(shown[canonical]).alias("x_display"), F.lit(matched).alias("matched"), F.lit(method).alias("method"))
    ruled = F.lit(None).cast("struct<x_canonical:string,x_display:string,matched:string,method:string>")
    for pattern, canonical in reversed([r for r in rules if r[1] in shown]):
        ruled = F.when(text.rlike(pattern), answer(canonical, pattern, "specific_rule")).otherwise(ruled)
    rest = F.lit(None).cast("struct<x_canonical:string,x_display:string,matched:string,method:string>")
    if fallback and fallback[1] in shown:
        rest = F.when(text.rlike(fallback[0]), answer(fallback[1], fallback[2], "generic_fallback"))
    own = rows.columns
    found = rows.withColumns({"x_text": normalised, "x_ruled": ruled, "x_rest": rest}).join(exact, F.col("x_text") == F.col("x_normalised"), "left")
    place = longest_alias(spark, [e.normalised for e in inside])
    found = found.withColumn("x_place", place(F.when(F.col("exact").isNull() & F.col("x_ruled").isNull(), F.col("x_text")))).join(listed, F.col("x_place") == F.col("x_at"), "left")
    best = F.when(F.col("x_text") != "", F.coalesce("exact", "x_ruled", "inside", "x_rest"))
    return found.withColumn("x_best", best).select(*own, F.col("x_best.x_canonical").alias("canonical"), F.col("x_best.x_display").alias("display"), F.col("x_best.matched").alias("matched"), F.col("x_best.method").alias("method"))
