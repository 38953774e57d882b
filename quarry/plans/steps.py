"""Multi-step queries: a graph of steps whose results join on exact keys, with coverage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.model import AnalysisPlan, PlanError

MOST_STEPS = 8


@dataclass(frozen=True)
class Step:
    id: str
    plan: AnalysisPlan
    keys: tuple[str, ...]
    mode: str = "enrich"  # enrich keeps unmatched anchor rows, filter drops them
    depends_on: tuple[str, ...] = ()
    fields: tuple[str, ...] = field(default_factory=tuple)


def ordered(steps: list[Step]) -> list[Step]:
    """The steps, each after those it depends on; cycles, unknown steps and too many of them are refused."""
    if not 1 <= len(steps) <= MOST_STEPS:
        raise PlanError(f"a query has 1 to {MOST_STEPS} steps")
    by_id = {s.id: s for s in steps}
    if len(by_id) < len(steps):
        raise PlanError("two steps share an id")
    done: dict[str, Step] = {}
    while len(done) < len(by_id):
        ready = [s for s in steps if s.id not in done and all(d in done for d in s.depends_on)]
        if not ready:
            raise PlanError("steps depend on each other, or on unknown ones")
        done |= {s.id: s for s in ready}
    return list(done.values())


def merged(steps: list[Step]) -> list[Step]:
    """Steps that differ only in their metrics become one, so that their sources are read once."""
    kept: list[Step] = []
    for s in steps:
        bare = replace(s.plan, metrics=())
        for k, other in enumerate(kept):
            if replace(other.plan, metrics=()) == bare and (other.keys, other.mode, other.depends_on) == (s.keys, s.mode, s.depends_on):
                both = tuple(dict.fromkeys((*other.plan.metrics, *s.plan.metrics)))
                kept[k] = replace(other, plan=replace(other.plan, metrics=both))
                break
        else:
            kept.append(s)
    return kept


def checked(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The rows with trimmed string keys; null, blank or repeated keys fail when the rows are read.

    Repeats are counted by an aggregate of the keys alone and joined back as a flag, so that a hot key needs no window.
    """
    kinds = dict(df.dtypes)
    # The check is part of the key itself: a filter for keys that aren't null, which the optimiser pushes below it, must not drop what it looks for.
    whole = {k: F.trim(k) if kinds[k] == "string" else F.col(k) for k in keys}
    blank = {k: (c.isNull() | (c == "")) if kinds[k] == "string" else c.isNull() for k, c in whole.items()}
    df = df.withColumns({k: F.when(blank[k], F.raise_error(F.lit(f"{what}: a join key is null or blank")).cast(kinds[k])).otherwise(c) for k, c in whole.items()})
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.count("*").alias("times"), F.any_value(F.struct(*rest) if rest else F.lit(1)).alias("row"))
    twice = F.when(F.col("times") > 1, F.raise_error(F.lit(f"{what}: a join key occurs twice")))
    return grouped.where(twice.isNull()).select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def attach(anchor: DataFrame, step: DataFrame, keys: list[str], mode: str = "enrich") -> DataFrame:
    """The anchor with a step's columns by exact keys; names that clash get the suffix `_2`."""
    renamed = {c: f"{c}_2" for c in step.columns if c in anchor.columns and c not in keys}
    side = checked(step, keys, "step").withColumnsRenamed(renamed)
    return anchor.join(side, keys, "left" if mode == "enrich" else "inner")


def coverage(anchor: DataFrame, step: DataFrame, keys: list[str]) -> DataFrame:
    """One row: anchor, matched and unmatched rows, and the rate (null for no anchor)."""
    found = step.select(*keys).distinct().withColumn("found", F.lit(1))
    both = anchor.join(found, keys, "left")
    return both.agg(F.count("*").alias("anchor"), F.count("found").alias("matched")).select(
        "anchor", "matched", (F.col("anchor") - F.col("matched")).alias("unmatched"), F.round(F.col("matched") / F.nullif("anchor", F.lit(0)), 6).alias("rate")
    )


def run(steps: list[Step], compile_: Callable[[AnalysisPlan, DataFrame | None], DataFrame]) -> DataFrame:
    """All steps as one lazy plan: a step reads only the keys of the one it depends on, and joins its result."""
    results: dict[str, DataFrame] = {}
    anchor: DataFrame | None = None
    for s in ordered(merged(steps)):
        keep = results[s.depends_on[0]].select(*s.keys).distinct() if s.depends_on else None
        results[s.id] = compile_(s.plan, keep)
        anchor = results[s.id] if anchor is None else attach(anchor, results[s.id], list(s.keys), s.mode)
    return anchor
