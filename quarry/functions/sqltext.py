"""What a query's text says, by patterns: tables, joins with their keys, fields, parameters and risks, and a score of its quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import scoring as sc
from quarry.functions.text import let, without_literals

_TABLE = r"((?:\[?\w+\]?\.)?\[?\w+\]?)"
_ALIAS = r"(?:\s+(?:as\s+)?(?!(?:on|where|inner|left|right|full|cross|join|group|order)\b)\w+)?"
_END = r"(?=\b(?:inner|left|right|full|cross)?\s*(?:outer\s+)?join\b|\bwhere\b|\bgroup\s+by\b|\border\s+by\b|$)"
_JOIN = rf"(?is)\bjoin\s+{_TABLE}{_ALIAS}\s+on\s+(.*?){_END}"
_COMPARED = r"(?i)((?:\w+\.)?\w+)\s*(?:=|<>|!=|>=|<=|>|<|like\b|in\b|between\b)"
#: Words that a query that only reads does not hold.
WRITES = "insert|update|delete|merge|drop|alter|create|truncate|exec|into"


def _all(c: Column, pattern: str, i: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(i))


def _list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def _bare(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\[\]]", ""))


def features(c: Column) -> Column:
    """struct(tables, joins, selected, filtered, grouped, ordered, params, kind, groups, macro, writes, statements) of a query's text.

    joins are (left, right, keys): the table before, the one joined, and the names that both sides are compared by. Literals
    and comments are no part of it but for parameters.
    """

    def told(t: Column) -> Column:
        tables = F.filter(F.array_distinct(F.transform(_all(t, rf"(?i)\b(?:from|join)\s+{_TABLE}"), _bare)), lambda x: ~x.startswith("#"))
        right = F.transform(_all(t, _JOIN, 1), _bare)
        left = F.concat(F.array(_bare(F.regexp_extract(t, rf"(?i)\bfrom\s+{_TABLE}", 1))), right)
        keys = F.transform(_all(t, _JOIN, 2), lambda on: F.array_sort(F.array_distinct(F.transform(_all(on, r"(?i)\b\w+\.(\w+)\s*=\s*\w+\.\1\b"), lambda k: F.lower(k)))))
        joins = F.zip_with(F.slice(left, 1, F.size(right)), F.arrays_zip(right.alias("right"), keys.alias("keys")), lambda a, b: F.struct(a.alias("left"), b["right"].alias("right"), b["keys"].alias("keys")))
        selected = F.transform(_list(F.regexp_extract(t, r"(?is)\bselect\s+(?:top\s+[0-9]+\s+)?(.*?)\bfrom\b", 1)), lambda x: F.regexp_replace(x, r"(?i)\s+as\s+.+$", ""))
        where = F.regexp_extract(t, r"(?is)\bwhere\b(.*?)(?:\bgroup\s+by\b|\border\s+by\b|$)", 1)
        return F.struct(
            tables.alias("tables"), joins.alias("joins"), selected.alias("selected"),
            F.array_distinct(F.transform(_all(where, _COMPARED), lambda x: F.lower(x))).alias("filtered"),
            _list(F.regexp_extract(t, r"(?is)\bgroup\s+by\b(.*?)(?:\bhaving\b|\border\s+by\b|$)", 1)).alias("grouped"),
            _list(F.regexp_extract(t, r"(?is)\border\s+by\b(.*)$", 1)).alias("ordered"),
            F.array_distinct(F.concat(_all(c, r"\$\{\s*(\w+)[^}]*\}"), _all(t, r"(?<!@)@(\w+)"))).alias("params"),
            F.when(t.rlike(r"(?i)^\s*(select|with)\b"), "select").otherwise("unknown").alias("kind"),
            t.rlike(r"(?i)\b(top\s+[0-9]+|limit\s+[0-9]+|(count|sum|avg|min|max)\s*\()").alias("groups"),
            c.contains("${").alias("macro"), t.rlike(rf"(?i)\b({WRITES})\b").alias("writes"),
            F.size(F.filter(F.split(t, ";"), lambda x: F.trim(x) != "")).alias("statements"),
        )

    return let(without_literals(c), told)


def risks(f: Column) -> Column:
    """Names of what is wrong with a query, in a fixed order."""
    return F.array_compact(F.array(
        F.when(f["writes"], "non_select_keyword"), F.when(f["macro"] | (F.size(f["params"]) > 0), "dynamic_parameter"),
        F.when(F.exists(f["joins"], lambda j: F.size(j["keys"]) == 0), "join_without_shared_key"),
        F.when(F.size(f["selected"]) == 0, "selected_fields_unparsed"), F.when(f["statements"] > 1, "several_statements"),
    ))


def quality(f: Column, known: tuple[str, ...], dates: str = "date") -> Column:
    """0 to 100: 60, more for what makes a query usable again, less for its risks. known: the tables of the model; dates: a pattern of date fields."""
    dated = F.exists(f["filtered"], lambda x: x.rlike(dates))
    parts = [
        F.lit(60), sc.weight(f["kind"] == "select", 15), sc.weight(F.arrays_overlap(f["tables"], F.array(*[F.lit(t) for t in known])), 20),
        sc.weight(~F.exists(f["joins"], lambda j: F.size(j["keys"]) == 0), 10), sc.weight(F.size(f["params"]) > 0, 10),
        F.when(F.size(f["selected"]) > 0, 10).otherwise(-10), sc.weight(f["groups"], 5), sc.weight(dated, 5),
        sc.weight(f["writes"], -50), sc.weight((F.size(f["tables"]) == 0) & (f["kind"] != "select"), -25), sc.weight(f["macro"], -20), sc.weight(f["statements"] > 1, -20),
    ]
    return sc.clamped(sc.total(*parts), 0, 100).cast("int")


def risk_level(score: Column, found: Column) -> Column:
    return F.when((score < 50) | F.array_contains(found, "non_select_keyword"), "high").when((score < 70) | (F.size(found) >= 2), "medium").otherwise("low")
