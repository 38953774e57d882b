"""From an analysis plan to one lazy DataFrame.

Each metric is aggregated by itself, filters first, so that no join fans out
rows; the aggregates are then joined on their shared keys. Only the tables that
the plan's dimensions need are joined to a metric's base.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.model import AnalysisPlan, Dimension, Metric, PlanError, clamp
from quarry.plans.windows import bounds, inside, period, shift

#: Joins by (from, to): the equal columns. A path follows them one after the other.
JOINS = {
    ("lineitem", "orders"): ("l_orderkey", "o_orderkey"),
    ("orders", "customer"): ("o_custkey", "c_custkey"),
    ("lineitem", "part"): ("l_partkey", "p_partkey"),
    ("lineitem", "supplier"): ("l_suppkey", "s_suppkey"),
    ("customer", "nation"): ("c_nationkey", "n_nationkey"),
    ("nation", "region"): ("n_regionkey", "r_regionkey"),
}
Tables = Callable[[str], DataFrame]


def joined(tables: Tables, base: str, needed: list[str]) -> DataFrame:
    """The base with every needed table, along the registered joins and what lies between."""
    order = [base]

    def path_to(target: str) -> list[str] | None:
        seen, front = {base: [base]}, [base]
        while front:
            here = front.pop(0)
            for a, b in JOINS:
                if a == here and b not in seen:
                    seen[b] = [*seen[here], b]
                    front.append(b)
        return seen.get(target)

    df = tables(base)
    for name in needed:
        path = path_to(name)
        if path is None:
            raise PlanError(f"no join path from {base!r} to {name!r}")
        for a, b in zip(path, path[1:], strict=False):
            if b not in order:
                left, right = JOINS[a, b]
                df = df.join(tables(b), F.col(left) == F.col(right))
                order.append(b)
    return df


def _condition(d: Dimension, values: tuple) -> Column:
    e = d.expression()
    if d.match == "contains":
        return reduce(lambda a, b: a | b, [e.contains(v) for v in values])
    if d.match == "number":
        return e.isin(*[int(v) for v in values])
    return e.isin(*values)


def _merged(plan: AnalysisPlan, name: str, e: Column) -> Column:
    for dimension, members, new in plan.merges:
        if dimension == name:
            e = F.when(e.isin(*members), F.lit(new)).otherwise(e)
    return e


def aggregate(tables: Tables, metric: Metric, plan: AnalysisPlan, windows: list[tuple[date, date]], keep: DataFrame | None = None) -> DataFrame:
    """One metric by the plan's dimensions and period, over the windows (all time if none). `keep` limits rows to its key tuples."""
    dims = {d: metric.dimensions[d] for d in plan.dimensions}
    filtered = {f: metric.dimensions[f] for f, _ in plan.filters}
    needed = list(dict.fromkeys([*metric.needs, *(n for d in [*dims.values(), *filtered.values()] for n in d.needs)]))
    df = joined(tables, metric.base, needed)
    if metric.where is not None:
        df = df.where(metric.where())
    for name, values in plan.filters:
        df = df.where(_condition(metric.dimensions[name], values))
    if windows:
        df = df.where(reduce(lambda a, b: a | b, [inside(metric.time(), w) for w in windows]))
    keys = {d: _merged(plan, d, e.expression()) for d, e in dims.items()}
    if plan.period:
        keys["period"] = period(metric.time(), plan.period)
    df = df.withColumns({f"key_{k}": e for k, e in keys.items()})
    if keep is not None:
        shared = [c for c in keep.columns if c in keys]
        df = df.join(F.broadcast(keep.distinct()) if keep.isLocal() else keep.distinct(), reduce(lambda a, b: a & b, [F.col(f"key_{c}") == keep[c] for c in shared]), "left_semi")
    return df.groupBy(*[F.col(f"key_{k}").alias(k) for k in keys]).agg(metric.aggregate().alias(metric.code))


def compile_plan(tables: Tables, catalog: dict[str, Metric], plan: AnalysisPlan, as_of: date, keep: DataFrame | None = None) -> DataFrame:
    """The plan's result: shared keys, then a column for each metric; with a comparison also `previous_`, `change_` and `rate_` columns."""
    metrics = plan.validate(catalog)
    if plan.comparison:
        result = compare(tables, metrics, plan, as_of, keep)
    else:
        windows = [bounds(plan.time, as_of)] if plan.time else []
        parts = [aggregate(tables, m, plan, windows, keep) for m in metrics]
        keys = [*plan.dimensions, *(["period"] if plan.period else [])]
        result = reduce(lambda a, b: a.join(b, keys) if keys else a.crossJoin(b), parts)  # without keys each side is one row
    for code, most in plan.below:
        result = result.where(F.col(code) < most)
    if plan.order_by:
        ties = [*plan.dimensions, *(["period"] if plan.period else [])]
        result = result.orderBy(F.desc_nulls_last(plan.order_by), *ties)
    return result.limit(clamp(plan.limit, 100, 1000)) if plan.limit is not None else result


def compare(tables: Tables, metrics: list[Metric], plan: AnalysisPlan, as_of: date, keep: DataFrame | None) -> DataFrame:
    """Current against the window shifted by a year or a month; entities absent now don't appear, those absent before have nulls."""
    if plan.time is None:
        raise PlanError("a comparison needs a time range")
    now = bounds(plan.time, as_of, comparing=True)
    back = 12 if plan.comparison == "year" else 1
    before = (shift(now[0], -back), shift(now[1], -back))
    keys = list(plan.dimensions)
    result = None
    for m in metrics:
        current = aggregate(tables, m, plan, [now], keep)
        previous = aggregate(tables, m, plan, [before], keep).withColumnRenamed(m.code, f"previous_{m.code}")
        both = current.join(previous, keys, "left") if keys else current.crossJoin(previous)  # one row each
        both = both.withColumn(f"change_{m.code}", F.col(m.code) - F.col(f"previous_{m.code}"))
        both = both.withColumn(f"rate_{m.code}", F.col(f"change_{m.code}") / F.nullif(F.abs(f"previous_{m.code}"), F.lit(0.0)))
        result = both if result is None else result.join(both, keys) if keys else result.crossJoin(both)
    return result
