"""The metric catalogue over the order tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from quarry.plans.model import Dimension, Metric

#: The day that relative time ranges refer to: the last order's.
AS_OF = date(2001, 8, 1)

_order_dimensions = {
    "tenant": Dimension(lambda: F.col("r_name"), ("customer", "nation", "region")),
    "customer": Dimension(lambda: F.col("c_name"), ("customer",), "contains"),
    "segment": Dimension(lambda: F.col("c_mktsegment"), ("customer",)),
    "status": Dimension(lambda: F.col("o_orderstatus"), ("orders",)),
    "priority": Dimension(lambda: F.col("o_orderpriority"), ("orders",)),
    "order": Dimension(lambda: F.col("o_orderkey"), ("orders",), "number"),
}
_line_dimensions = _order_dimensions | {
    "category": Dimension(lambda: F.col("p_type"), ("part",)),
    "brand": Dimension(lambda: F.col("p_brand"), ("part",)),
    "product": Dimension(lambda: F.col("p_name"), ("part",)),
    "supplier": Dimension(lambda: F.col("s_name"), ("supplier",)),
    "flag": Dimension(lambda: F.col("l_returnflag")),
}
_head = {k: Dimension(v.expression, tuple(n for n in v.needs if n != "orders"), v.match) for k, v in _order_dimensions.items()}


def _net():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _ordered():
    return F.col("o_orderdate")


def _shipped():
    return F.col("l_shipdate")


CATALOG = {
    m.code: m
    for m in (
        Metric("order_amount", "lineitem", lambda: F.round(F.sum(_net()), 4), _ordered, needs=("orders",), dimensions=_line_dimensions),
        Metric("order_quantity", "lineitem", lambda: F.sum("l_quantity"), _ordered, needs=("orders",), dimensions=_line_dimensions),
        Metric("shipped_amount", "lineitem", lambda: F.round(F.sum(_net()), 4), _shipped, needs=("orders",), dimensions=_line_dimensions),
        Metric("order_total", "orders", lambda: F.round(F.sum("o_totalprice"), 2), _ordered, dimensions=_head, grain="order"),
        Metric("order_count", "orders", lambda: F.count_distinct("o_orderkey"), _ordered, dimensions=_head, grain="order"),
        Metric("customer_count", "orders", lambda: F.count_distinct("o_custkey"), _ordered, dimensions=_head, grain="order"),
        Metric("discount_rate", "lineitem", lambda: F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.nullif(F.sum("l_extendedprice"), F.lit(0.0)), 6), _ordered, needs=("orders",), dimensions=_line_dimensions),
        Metric("delay_days_max", "lineitem", lambda: F.max(F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))), _ordered, needs=("orders",), dimensions=_line_dimensions),
        Metric("overdue_amount", "lineitem", lambda: F.round(F.sum(_net()), 4), _shipped, where=lambda: (F.col("o_orderstatus") == "O") & (F.col("l_shipdate").cast("date") < F.lit(AS_OF)), needs=("orders",), dimensions=_line_dimensions),
        Metric("prorated_amount", "lineitem", lambda: F.round(F.sum(F.col("l_extendedprice") * F.floor(F.col("l_quantity") / 2) / F.nullif(F.col("l_quantity"), F.lit(0.0))), 4), _shipped, dimensions={k: v for k, v in _line_dimensions.items() if k in ("category", "brand", "flag", "supplier")}),
    )
}
