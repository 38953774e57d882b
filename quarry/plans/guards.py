"""Checks of SQL text before it runs. Spark's own parser and analyser say what a query reads and computes; see `lineage`."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from quarry.plans.lineage import Lineage, kind, relations, seq
from quarry.plans.model import PlanError

#: Names that stand for a tenant in a draft, and would make its result empty.
PLACEHOLDERS = frozenset({"yourcompany", "companycode", "companyid"})


@dataclass(frozen=True)
class Reference:
    """What a finance query rests on. A metric declares its table, amount, status field, time field and the conditions on the status."""

    source: str  # metric or template; for an estimate also dataset or family
    table: str = ""
    amount: str = ""
    status_field: str = ""
    time_field: str = ""
    status: tuple[str, ...] = ()


@dataclass(frozen=True)
class Finance:
    """Rules of a finance query: its references, the columns that explain its scope, and detail tables with the document number they are summed by."""

    references: tuple[Reference, ...] = ()
    estimate: bool = False
    scope_columns: tuple[str, ...] = ("time_scope", "amount_scope", "status_scope", "tax_scope")
    details: tuple[tuple[str, str], ...] = (("lineitem", "l_orderkey"),)
    amount: str = r"amount|amt|cost|price|total|debit|credit|balance|acctbal|tax"
    status: str = r"status|posted|closed|void|cancel|paid|hold|approv|flag"
    date: str = r"date|(^|_)ts$"


class Inspected:
    """A query over given tables, analysed in a session of its own, and its lineage. Nothing runs, and the caller's session stays as it is."""

    def __init__(self, spark: SparkSession, sql: str, tables: dict[str, DataFrame], args: dict | None = None) -> None:
        jvm = spark._jvm
        self._session = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
        self._jvm = jvm
        try:
            used = relations(self._session._jsparkSession.sessionState().sqlParser().parsePlan(sql))
        except ParseException as e:
            raise PlanError(f"not a single query: {e.getMessage().splitlines()[0]}") from e
        known = {t.lower(): t for t in tables}
        if unknown := used - known.keys():
            raise PlanError(f"table {sorted(unknown)[0]!r} is not known")
        for name in used:
            given = tables[known[name]]._jdf.queryExecution().analyzed()
            jvm.org.apache.spark.sql.classic.Dataset.ofRows(self._session._jsparkSession, given).createOrReplaceTempView(name)
        self.tables = used
        self.plan = self._analyse(sql, args)
        self.lineage = Lineage(jvm, self.plan)
        self.output = [a.name() for a in seq(self.plan.output())]

    def _analyse(self, sql: str, args: dict | None = None):
        try:
            return self._session.sql(sql, args=args or {})._jdf.queryExecution().analyzed()
        except AnalysisException as e:
            raise PlanError(e.getMessage().splitlines()[0]) from e

    def conditions(self, table: str, condition: str) -> tuple[set[str], set[str]]:
        """The keys of a condition's parts on a table, as `Leaf.holds` has them, and the columns that they name."""
        if table.lower() not in self.tables:
            return {""}, set()
        lineage = Lineage(self._jvm, self._analyse(f"SELECT 1 FROM `{table}` WHERE {condition}"))
        return lineage.leaves[0].holds, {c for _, c in lineage.used}

    def own_columns(self, name: str) -> bool:
        """Whether a result column is a table's own column of that name, not an expression that is called so."""
        mine = [a for a in seq(self.plan.output()) if a.name().lower() == name.lower()]
        bases = [self.lineage.direct.get(a.exprId().id(), ()) for a in mine]
        return any(b and all(c == name.lower() for _, _, c in b) for b in bases)

    def dataframe(self, spark: SparkSession) -> DataFrame:
        return DataFrame(self._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, self.plan), spark)


def _grouped(plan) -> bool:
    """Whether a plan's own rows are groups: an aggregate with nothing between it and the result that could add rows."""
    while kind(plan) in ("Project", "Filter", "Sort", "SubqueryAlias", "GlobalLimit", "LocalLimit", "Distinct", "Offset", "WithCTE"):
        plan = plan.plan() if kind(plan) == "WithCTE" else plan.child()
    return kind(plan) == "Aggregate"


def _combined(plan) -> bool:
    return kind(plan) in ("Union", "Intersect", "Except") or any(_combined(c) for c in seq(plan.children()))


def finance_errors(query: Inspected, rules: Finance) -> list[str]:
    """What a finance query lacks: approved references, fields, conditions on the status that hold for every row it sums, and columns that explain it."""
    errors = []
    allowed = ("metric", "template", "dataset", "family") if rules.estimate else ("metric", "template")
    if not any(r.source in allowed for r in rules.references):
        errors.append("an estimate needs a reference" if rules.estimate else "a finance query needs an approved metric or template")
    metrics = [r for r in rules.references if r.source == "metric"]
    for m in metrics:
        if not m.amount.strip():
            errors.append("an approved metric has to declare its amount")
        if not m.status_field.strip():
            errors.append("an approved metric has to declare its status field")
        if not any(c.strip() for c in m.status):
            errors.append("an approved metric has to declare a condition on its status")
            continue
        if m.table.lower() not in query.tables:
            errors.append(f"the query doesn't read {m.table!r}, which the metric is of")
            continue
        wanted = [query.conditions(m.table, c) for c in m.status if c.strip()]
        if not any(m.status_field.lower() in columns for _, columns in wanted):
            errors.append("an approved metric's conditions have to be on its status field")
        read = [leaf for leaf in query.lineage.leaves if leaf.table == m.table.lower()]
        if not read or not all(keys <= leaf.holds for keys, _ in wanted for leaf in read):
            errors.append("every approved condition on the status has to hold for all rows that are read")
    used = {c for _, c in query.lineage.used}
    for what, pattern, declared in (("amount", rules.amount, "amount"), ("status", rules.status, "status_field"), ("date", rules.date, "time_field")):
        if not any(re.search(pattern, c, re.I) for c in used) and not any(getattr(m, declared) for m in metrics):
            errors.append(f"a finance query has to use a field of {what}")
    if not metrics:
        held = [k for leaf in query.lineage.leaves for k in leaf.holds]
        if not any(re.search(rules.status, k, re.I) and "?" not in k for k in held):
            errors.append("a finance query has to filter a status field")
    details = dict(rules.details)
    for _, right in query.lineage.joins:
        if any(leaf.table in details and details[leaf.table] not in leaf.grouped for leaf in right):
            errors.append("details have to be summed by their document before they are joined")
    shown = {c.lower() for c in query.output}
    errors += [f"the column {c!r} is missing, which explains the scope" for c in rules.scope_columns if c.lower() not in shown]
    return list(dict.fromkeys(errors))


def guarded(
    spark: SparkSession, sql: str, tables: dict[str, DataFrame], args: dict | None = None, tenant: str | None = None, most: int | None = None, finance: Finance | None = None
) -> DataFrame:
    """A single query over the given tables only, with bound parameters, as a DataFrame.

    What it reads and computes is told from Spark's resolved plan: each operator and expression has to be of a listed class.
    The tenant column must be among its columns, as a table's own column, in a query without set operations, and is not
    compared with a placeholder; a query that is not an aggregate itself is limited. With `finance`, its rules hold too.
    """
    query = Inspected(spark, sql, tables, args)
    if tenant and (_combined(query.plan) or not query.own_columns(tenant)):
        raise PlanError(f"the result lacks the tenant column {tenant!r}")
    if tenant and any(tenant.lower() in columns and value.lower() in PLACEHOLDERS for columns, value in query.lineage.literals):
        raise PlanError("a placeholder stands for the tenant; leave the condition out, the scope limits tenants")
    if finance and (errors := finance_errors(query, finance)):
        raise PlanError("; ".join(errors))
    df = query.dataframe(spark)
    return df if most is None or _grouped(query.plan) else df.limit(most)


def columns(df: DataFrame) -> list[dict]:
    """For each column its label, kind and role, from its name and type."""
    out = []
    for name, kind in df.dtypes:
        if re.search(r"rate|ratio|share|percent", name, re.I):
            shown = "percent"
        elif re.search(r"amount|price|total|cost|spend", name, re.I):
            shown = "money"
        elif kind in ("date", "timestamp", "timestamp_ntz") or name in ("period", "day"):
            shown = "date"
        elif kind in ("int", "bigint", "smallint", "tinyint"):
            shown = "integer"
        else:
            shown = "text"
        role = "technical" if re.search(r"(^|_)(id|key|hash)$", name) else "metric" if shown in ("percent", "money") or kind == "double" else "dimension"
        out.append({"key": name, "label": name.replace("_", " ").capitalize(), "dataType": shown, "role": role})
    return out
