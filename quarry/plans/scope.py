"""Access scope: row limits on every table that a query reads, and masked columns. What can't be enforced fails."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.model import PlanError
from quarry.sources.tables import table

#: How each governed table reaches its tenant: a chain of (table, own key, its key).
TENANT_PATH = {
    "region": (),
    "nation": (("region", "n_regionkey", "r_regionkey"),),
    "customer": (("nation", "c_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey")),
    "supplier": (("nation", "s_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey")),
    "orders": (("customer", "o_custkey", "c_custkey"), ("nation", "c_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey")),
    "lineitem": (("orders", "l_orderkey", "o_orderkey"), ("customer", "o_custkey", "c_custkey"), ("nation", "c_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey")),
}
SHARED = frozenset({"part"})  # master data of all tenants
#: Column classes by name, and what masking does to them.
FINANCE = re.compile(r"price|amount|acctbal|cost|total", re.I)
PERSON = re.compile(r"(^|_)name$|customer|employee|clerk", re.I)


#: Tables of tenants and their places, whose keys can be listed in a filter, up to so many.
LOOKUPS = ("region", "nation")
LISTED = 1000


@dataclass(frozen=True)
class AccessScope:
    """Tenants that may be read (None: all of them), and whether finance and person columns are shown."""

    tenants: tuple[str, ...] | None = None
    finance: bool = True
    persons: bool = True
    restricted: frozenset[str] = field(default_factory=frozenset)  # tables that may not be read

    def check(self, tenants: tuple[str, ...]) -> None:
        """Literal tenants of a plan must lie in the scope."""
        if self.tenants is not None and (outside := [t for t in tenants if t not in self.tenants]):
            raise PlanError(f"tenant {outside[0]!r} is out of scope")


def scoped(spark: SparkSession, sf_dir: str, name: str, scope: AccessScope) -> DataFrame:
    """The table's rows of the scope's tenants, by semi joins along its path; unmapped tables are refused."""
    if scope.tenants is not None and not scope.tenants:
        raise PlanError("the scope has no tenant")
    if name in scope.restricted or (name not in TENANT_PATH and name not in SHARED):
        raise PlanError(f"table {name!r} has no access rule")
    df = table(spark, sf_dir, name)
    if scope.tenants is None or name in SHARED:
        return df
    allowed = table(spark, sf_dir, "region").where(F.col("r_name").isin(*scope.tenants))
    if name == "region":
        return allowed
    path = TENANT_PATH[name]
    few = True  # from the tenants on, keys are written into the next table's filter, as long as they are few
    for k in range(len(path) - 1, -1, -1):
        own, key = path[k][1], path[k][2]
        source = df if k == 0 else table(spark, sf_dir, path[k - 1][0])
        if few:
            keys = [r[0] for r in allowed.select(key).distinct().limit(LISTED + 1).collect()]
            few = len(keys) <= LISTED and path[k][0] in LOOKUPS
        if few:
            allowed = source.where(F.col(own).isin(keys))
        else:
            allowed = source.join(allowed.select(F.col(key).alias("scope_key")), F.col(own) == F.col("scope_key"), "left_semi")
    return allowed


def masked_name(c: Column) -> Column:
    """First and last character with up to six stars between; two characters or fewer are `**`."""
    stars = F.repeat(F.lit("*"), F.least(F.lit(6), F.length(c) - 2))
    return F.when(c.isNull(), c).when(F.length(c) <= 2, "**").otherwise(F.concat(F.left(c, F.lit(1)), stars, F.right(c, F.lit(1))))


def masked(df: DataFrame, scope: AccessScope) -> DataFrame:
    """The rows with hidden finance columns as nulls and hidden person columns masked."""
    hidden = {}
    for name, kind in df.dtypes:
        if not scope.finance and FINANCE.search(name):
            hidden[name] = F.lit(None).cast(kind)
        elif not scope.persons and kind == "string" and PERSON.search(name):
            hidden[name] = masked_name(F.col(name))
    return df.withColumns(hidden) if hidden else df
