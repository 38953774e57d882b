"""The typed analysis plan: metrics, dimensions, filters, time and shape, with validation that fails closed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column


class PlanError(ValueError):
    """A plan that must not run: an unknown metric or dimension, a clash of grains, or an unenforceable limit."""


@dataclass(frozen=True)
class Dimension:
    """A grouping expression and the tables it needs besides the metric's base."""

    expression: Callable[[], Column]
    needs: tuple[str, ...] = ()
    match: str = "equals"  # how a filter compares: equals, contains or number


@dataclass(frozen=True)
class Metric:
    """An atomic metric: base table, aggregate over an expression, time column, and its own conditions."""

    code: str
    base: str
    aggregate: Callable[[], Column]
    time: Callable[[], Column] | None = None
    where: Callable[[], Column] | None = None
    needs: tuple[str, ...] = ()
    dimensions: dict[str, Dimension] = field(default_factory=dict)
    grain: str = "line"
    enabled: bool = True


@dataclass(frozen=True)
class TimeRange:
    """kind: current_year, year_to_date, first_half, current_month, previous_month, month (with value YYYY-MM), complete_months (with count), days (with count)."""

    kind: str
    value: str | None = None
    count: int = 0


@dataclass(frozen=True)
class AnalysisPlan:
    metrics: tuple[str, ...]
    dimensions: tuple[str, ...] = ()
    filters: tuple[tuple[str, tuple], ...] = ()  # dimension, allowed values
    below: tuple[tuple[str, float], ...] = ()  # metric, threshold (after aggregation)
    time: TimeRange | None = None
    comparison: str | None = None  # "year" or "month"
    period: str | None = None  # "month" or "year"
    merges: tuple[tuple[str, tuple[str, ...], str], ...] = ()  # dimension, members, new name
    order_by: str | None = None
    limit: int | None = None

    def validate(self, catalog: dict[str, Metric]) -> list[Metric]:
        if not self.metrics:
            raise PlanError("a plan needs a metric")
        found = []
        for code in self.metrics:
            metric = catalog.get(code)
            if metric is None or not metric.enabled:
                raise PlanError(f"metric {code!r} is not available")
            missing = [d for d in (*self.dimensions, *(f for f, _ in self.filters)) if d not in metric.dimensions]
            if missing:
                raise PlanError(f"metric {code!r} has no dimension {missing[0]!r}")
            if (self.time or self.period or self.comparison) and metric.time is None:
                raise PlanError(f"metric {code!r} has no time")
            found.append(metric)
        if len({m.grain for m in found}) > 1 and not self.dimensions and not self.period:
            raise PlanError("metrics of different grains need a shared key")
        if self.order_by is not None and self.order_by not in self.metrics:
            raise PlanError("only a selected metric can order the result")
        for _, values in self.filters:
            if not 1 <= len(values) <= 500 or any(v is None or v == "" for v in values):
                raise PlanError("a filter takes 1 to 500 values, none of them empty")
        if self.comparison and self.comparison not in ("year", "month"):
            raise PlanError(f"unknown comparison {self.comparison!r}")
        return found


def clamp(n: int | None, default: int, most: int) -> int:
    return max(1, min(most, default if n is None else n))
