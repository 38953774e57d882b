"""How good ranked answers are, against what is known to be right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval(answers: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """Figures of ranked answers by groups: n, answered, top1_precision, top3_recall, coverage, false_match_rate, abstention_correctness, mrr.

    answers: query, rank (from 1) and item; gold: query, item (null: no answer would be right) and the columns of `by`. A
    query without answers abstains. Shares without a denominator are null. Only the best three answers of a query matter
    but for mrr, so that lists are joined with what is right and summed, never gathered.
    """
    right = answers.join(gold.select(F.col("query").alias("q"), F.col("item").alias("right")), F.col("query") == F.col("q"), "inner")
    place = right.groupBy("query").agg(F.min(F.when(F.col("item") == F.col("right"), F.col("rank"))).alias("place"))
    each = gold.join(place.withColumn("answered", F.lit(True)), "query", "left").withColumn("answered", F.coalesce("answered", F.lit(False)))
    known, answered, first = F.col("item").isNotNull(), F.col("answered"), F.coalesce(F.col("place") == 1, F.lit(False))
    share = lambda a, b: F.round(F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)), 6)
    return each.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(answered).alias("answered"), share(answered & first, answered).alias("top1_precision"), share(known & (F.col("place") <= 3), known).alias("top3_recall"),
        share(answered, F.lit(True)).alias("coverage"), share(answered & ~first, answered).alias("false_match_rate"), share(~known & ~answered, ~known).alias("abstention_correctness"),
        F.round(F.sum(F.coalesce(1 / F.col("place"), F.lit(0.0))) / F.nullif(F.count_if(known), F.lit(0)), 6).alias("mrr"),
    )


def effect(before: DataFrame, after: DataFrame, by: list[str], figures: list[str]) -> DataFrame:
    """What changed between two tables of figures: for each group `<figure>_before`, `_after` and `_delta`; groups that only one has are there too."""
    b, a = (d.select(*by, *[F.col(c).alias(f"{c}_{when}") for c in figures]) for d, when in ((before, "before"), (after, "after")))
    return b.join(a, by, "full").select(*by, *[x for c in figures for x in (f"{c}_before", f"{c}_after", F.round(F.col(f"{c}_after") - F.col(f"{c}_before"), 6).alias(f"{c}_delta"))])
