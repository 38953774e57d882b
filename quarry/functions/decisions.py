"""Decision tables: rules as data, compiled to one expression that says which rule fired and what follows.

A rule has conditions (column, test, value) that must all hold; a condition can be
a list of alternatives. The value may be another column, by `Of`. Nulls fulfil no
test but `unknown`. Rules are tried in order; the default follows where none holds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Of:
    """Another column of the table, as the value of a test."""

    column: str


#: What can be asked of a column.
TESTS = {
    "is": lambda c, v: c == v,
    "not": lambda c, v: ~c.eqNullSafe(v),
    "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~F.coalesce(c.isin(*v), F.lit(False)),
    "matches": lambda c, v: c.rlike(v),
    "lacks": lambda c, v: ~F.coalesce(c.rlike(v), F.lit(False)),
    "at_least": lambda c, v: c >= v,
    "above": lambda c, v: c > v,
    "at_most": lambda c, v: c <= v,
    "below": lambda c, v: c < v,
    "known": lambda c, v: c.isNotNull() == v,
}
Condition = tuple[str, str, Any] | list
Rule = tuple[str, tuple, dict[str, Any]]


@dataclass(frozen=True)
class DecisionTable:
    """Rules (name, conditions, outcome) over named columns; each outcome, and the default, gives a value for each of `outcomes`."""

    columns: tuple[str, ...]
    outcomes: tuple[str, ...]
    rules: tuple[Rule, ...]
    default: dict[str, Any]

    def __post_init__(self) -> None:
        names = [n for n, _, _ in self.rules]
        if len(set(names)) < len(names) or "default" in names:
            raise ValueError("rules need names of their own")
        for name, conditions, outcome in (*self.rules, ("default", ((self.columns[0], "known", True),), self.default)):
            if set(outcome) != set(self.outcomes):
                raise ValueError(f"rule {name!r} has to give {self.outcomes}")
            for c in self._flat(conditions):
                if c[0] not in self.columns or c[1] not in TESTS or (isinstance(c[2], Of) and c[2].column not in self.columns):
                    raise ValueError(f"rule {name!r} has no such condition: {c}")
        if any(not conditions for _, conditions, _ in self.rules[:-1]):
            raise ValueError("rules after one without conditions are never tried")

    def _flat(self, conditions) -> list:
        return [x for c in conditions for x in (self._flat(c) if isinstance(c, list) else [c])]

    def _holds(self, conditions, given: dict[str, Column]) -> Column:
        def one(c) -> Column:
            if isinstance(c, list):
                return reduce(lambda a, b: a | b, map(one, c))
            column, test, value = c
            return F.coalesce(TESTS[test](given[column], given[value.column] if isinstance(value, Of) else value), F.lit(False))

        return reduce(lambda a, b: a & b, map(one, conditions), F.lit(True))

    def _given(self, columns: dict[str, Column] | None) -> dict[str, Column]:
        return {c: (columns or {}).get(c, F.col(c)) for c in self.columns}

    def _outcome(self, name: str, outcome: dict[str, Any], given: dict[str, Column]) -> Column:
        value = lambda v: given[v.column] if isinstance(v, Of) else F.lit(v)
        return F.struct(F.lit(name).alias("rule"), *[value(outcome[o]).alias(o) for o in self.outcomes])

    def first(self, columns: dict[str, Column] | None = None) -> Column:
        """struct(rule, outcomes) of the first rule that holds. `columns` names the expressions of columns that aren't called so."""
        given = self._given(columns)
        e = self._outcome("default", self.default, given)
        for name, conditions, outcome in reversed(self.rules):
            e = F.when(self._holds(conditions, given), self._outcome(name, outcome, given)).otherwise(e)
        return e

    def every(self, columns: dict[str, Column] | None = None) -> Column:
        """array<struct(rule, outcomes)> of all rules that hold, in order."""
        given = self._given(columns)
        return F.array_compact(F.array(*[F.when(self._holds(c, given), self._outcome(n, o, given)) for n, c, o in self.rules]))
