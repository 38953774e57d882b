"""Queries over the metric compiler."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.plans.catalog import AS_OF, CATALOG
from quarry.plans.compiler import compile_plan
from quarry.plans.model import AnalysisPlan, TimeRange, clamp
from quarry.plans.windows import period
from quarry.queries.registry import Registry
from quarry.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

OLI = "lineitem JOIN orders ON o_orderkey = l_orderkey"
NET = "l_extendedprice * (1 - l_discount)"
MONTH = "strftime(CAST(o_orderdate AS DATE), '%Y-%m')"
DAY = "CAST(o_orderdate AS DATE)"


def ask(spark, sf_dir, **plan):
    return compile_plan(lambda name: table(spark, sf_dir, name), CATALOG, AnalysisPlan(**plan), AS_OF)


@R.query(
    "metric_order_amount_by_category_month",
    f"SELECT p_type AS category, {MONTH} AS period, round(sum({NET}), 4) AS order_amount FROM {OLI} JOIN part ON p_partkey = l_partkey GROUP BY 1, 2",
)
def order_amount(spark, sf_dir):
    return ask(spark, sf_dir, metrics=("order_amount",), dimensions=("category",), period="month")


@R.query(
    "metric_multi_inner_compose",
    f"""WITH a AS (SELECT o_orderpriority AS priority, {MONTH} AS period, round(sum({NET}), 4) AS order_amount,
               round(sum(l_extendedprice * l_discount) / nullif(sum(l_extendedprice), 0), 6) AS discount_rate FROM {OLI} GROUP BY 1, 2),
        b AS (SELECT o_orderpriority AS priority, {MONTH} AS period, count(DISTINCT o_orderkey) AS order_count FROM orders GROUP BY 1, 2)
        SELECT priority, period, order_amount, discount_rate, order_count FROM a JOIN b USING (priority, period)""",
)
def multi(spark, sf_dir):
    return ask(spark, sf_dir, metrics=("order_amount", "discount_rate", "order_count"), dimensions=("priority",), period="month")


@R.query(
    "metric_scope_columns",
    """SELECT r_name AS tenant, c_mktsegment AS segment, round(sum(o_totalprice), 2) AS order_total,
       'order date; all time' AS time_scope, 'order total; all statuses; tax as booked' AS amount_scope
       FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
       WHERE c_mktsegment = 'BUILDING' AND contains(c_name, '1') GROUP BY 1, 2""",
)
def scope_columns(spark, sf_dir):
    df = ask(spark, sf_dir, metrics=("order_total",), dimensions=("tenant", "segment"), filters=(("segment", ("BUILDING",)), ("customer", ("1",))))
    return df.withColumns({"time_scope": F.lit("; ".join(("order date", "all time"))), "amount_scope": F.lit("; ".join(("order total", "all statuses", "tax as booked")))})


@R.query("metric_having_lt", f"SELECT s_name AS supplier, sum(l_quantity) AS order_quantity FROM {OLI} JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1 HAVING sum(l_quantity) < 16000")
def having(spark, sf_dir):
    return ask(spark, sf_dir, metrics=("order_quantity",), dimensions=("supplier",), below=(("order_quantity", 16000),))


@R.query(
    "metric_status_overdue",
    f"""SELECT o_orderpriority AS priority, round(sum({NET}), 4) AS overdue_amount FROM {OLI}
        WHERE o_orderstatus = 'O' AND CAST(l_shipdate AS DATE) < DATE '2001-08-01'
        AND CAST(l_shipdate AS DATE) >= DATE '2001-01-01' AND CAST(l_shipdate AS DATE) < DATE '2002-01-01' GROUP BY 1""",
)
def overdue(spark, sf_dir):
    return ask(spark, sf_dir, metrics=("overdue_amount",), dimensions=("priority",), time=TimeRange("current_year"))


@R.query("metric_delay_days_max", f"SELECT p_brand AS brand, max(date_diff('day', {DAY}, CAST(l_shipdate AS DATE))) AS delay_days_max FROM {OLI} JOIN part ON p_partkey = l_partkey GROUP BY 1")
def delay(spark, sf_dir):
    return ask(spark, sf_dir, metrics=("delay_days_max",), dimensions=("brand",))


@R.query("metric_count_distinct", f"SELECT o_orderstatus AS status, strftime({DAY}, '%Y') AS period, count(DISTINCT o_orderkey) AS order_count, count(DISTINCT o_custkey) AS customer_count FROM orders GROUP BY 1, 2")
def counts(spark, sf_dir):
    return ask(spark, sf_dir, metrics=("order_count", "customer_count"), dimensions=("status",), period="year")


@R.query("metric_prorated_amount", "SELECT l_returnflag AS flag, round(sum(l_extendedprice * floor(l_quantity / 2) / nullif(l_quantity, 0)), 4) AS prorated_amount FROM lineitem GROUP BY 1")
def prorated(spark, sf_dir):
    return ask(spark, sf_dir, metrics=("prorated_amount",), dimensions=("flag",))


def _comparison_sql(now, before):
    part = "SELECT o_orderpriority AS priority, round(sum(o_totalprice), 2) AS v FROM orders WHERE {d} >= DATE '{a}' AND {d} < DATE '{b}' GROUP BY 1"
    return f"""WITH n AS ({part.format(d=DAY, a=now[0], b=now[1])}), p AS ({part.format(d=DAY, a=before[0], b=before[1])})
        SELECT priority, n.v AS order_total, p.v AS previous_order_total, round(n.v - p.v, 2) AS change_order_total,
               round((n.v - p.v) / nullif(abs(p.v), 0), 6) AS rate_order_total FROM n LEFT JOIN p USING (priority)"""


def _rounded(df):
    return df.withColumns({"change_order_total": F.round("change_order_total", 2), "rate_order_total": F.round("rate_order_total", 6)})


@R.query("period_yoy_compare", _comparison_sql(("2001-01-01", "2001-08-02"), ("2000-01-01", "2000-08-02")))
def year_over_year(spark, sf_dir):
    return _rounded(ask(spark, sf_dir, metrics=("order_total",), dimensions=("priority",), time=TimeRange("current_year"), comparison="year"))


@R.query("period_mom_compare", _comparison_sql(("2001-07-01", "2001-08-01"), ("2001-06-01", "2001-07-01")))
def month_over_month(spark, sf_dir):
    return _rounded(ask(spark, sf_dir, metrics=("order_total",), dimensions=("priority",), time=TimeRange("previous_month"), comparison="month"))


@R.query("period_ytd_window", f"SELECT o_orderstatus AS status, round(sum(o_totalprice), 2) AS order_total FROM orders WHERE {DAY} >= DATE '2001-01-01' AND {DAY} < DATE '2001-08-02' GROUP BY 1")
def to_date(spark, sf_dir):
    return ask(spark, sf_dir, metrics=("order_total",), dimensions=("status",), time=TimeRange("year_to_date"))


@R.query("period_last_3_complete_months", f"SELECT {MONTH} AS period, round(sum(o_totalprice), 2) AS order_total FROM orders WHERE {DAY} >= DATE '2001-05-01' AND {DAY} < DATE '2001-08-01' GROUP BY 1")
def complete_months(spark, sf_dir):
    return ask(spark, sf_dir, metrics=("order_total",), period="month", time=TimeRange("complete_months", count=3))


@R.query("period_first_half_total", f"SELECT o_orderpriority AS priority, count(DISTINCT o_orderkey) AS order_count FROM orders WHERE {DAY} >= DATE '2001-01-01' AND {DAY} < DATE '2001-07-01' GROUP BY 1")
def first_half(spark, sf_dir):
    return ask(spark, sf_dir, metrics=("order_count",), dimensions=("priority",), time=TimeRange("first_half"))


@R.query("period_named_month", f"SELECT c_mktsegment AS segment, round(sum(o_totalprice), 2) AS order_total FROM orders JOIN customer ON c_custkey = o_custkey WHERE {DAY} >= DATE '2000-02-01' AND {DAY} < DATE '2000-03-01' GROUP BY 1")
def named_month(spark, sf_dir):
    return ask(spark, sf_dir, metrics=("order_total",), dimensions=("segment",), time=TimeRange("month", value="2000-02"))


@R.query(
    "sales_growth_topn",
    f"""WITH g AS (SELECT p_brand AS brand, round(sum(CASE WHEN {MONTH} = '2001-06' THEN {NET} ELSE 0 END), 4) AS earliest,
                round(sum(CASE WHEN {MONTH} = '2001-07' THEN {NET} ELSE 0 END), 4) AS latest
                FROM {OLI} JOIN part ON p_partkey = l_partkey WHERE {MONTH} IN ('2001-06', '2001-07') GROUP BY 1)
        SELECT brand, earliest, latest, round((latest - earliest) / nullif(abs(earliest), 0), 6) AS growth FROM g ORDER BY growth DESC NULLS LAST, brand LIMIT 20""",
)
def growth(spark, sf_dir, limit=None):
    """Two months side by side from one pass, best growth first."""
    line, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    month, net = period(F.col("o_orderdate"), "month"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    sums = {n: F.round(F.sum(F.when(month == m, net).otherwise(0.0)), 4).alias(n) for n, m in (("earliest", "2001-06"), ("latest", "2001-07"))}
    day = F.col("o_orderdate").cast("date")
    df = (
        line.join(orders.where((day >= "2001-06-01") & (day < "2001-08-01")), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("p_partkey") == F.col("l_partkey"))
        .groupBy(F.col("p_brand").alias("brand")).agg(*sums.values())
    )
    rate = F.round((F.col("latest") - F.col("earliest")) / F.nullif(F.abs("earliest"), F.lit(0.0)), 6)
    return df.withColumn("growth", rate).orderBy(F.desc_nulls_last("growth"), "brand").limit(clamp(limit, 20, 500))


@R.query(
    "growth_first_last_period",
    f"""WITH m AS (SELECT c_mktsegment AS segment, {MONTH} AS period, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
        SELECT segment, arg_min(total, period) AS first_total, arg_max(total, period) AS last_total,
        CASE WHEN count(*) >= 2 THEN round((arg_max(total, period) - arg_min(total, period)) / nullif(abs(arg_min(total, period)), 0), 6) END AS growth FROM m GROUP BY 1""",
)
def first_last(spark, sf_dir):
    months = ask(spark, sf_dir, metrics=("order_total",), dimensions=("segment",), period="month")
    first, last = F.min_by("order_total", "period"), F.max_by("order_total", "period")
    rate = F.when(F.count("*") >= 2, F.round((last - first) / F.nullif(F.abs(first), F.lit(0.0)), 6))
    return months.groupBy("segment").agg(first.alias("first_total"), last.alias("last_total"), rate.alias("growth"))


@R.query(
    "customer_concentration",
    f"""WITH a AS (SELECT p_brand AS brand, o_custkey AS customer, round(sum({NET}), 4) AS amount FROM {OLI} JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
        SELECT brand, customer, amount, round(amount / nullif(sum(amount) OVER (PARTITION BY brand), 0), 8) AS share, count(customer) OVER (PARTITION BY brand) AS customers FROM a""",
)
def concentration(spark, sf_dir):
    line, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    amounts = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("p_partkey") == F.col("l_partkey"))
        .groupBy(F.col("p_brand").alias("brand"), F.col("o_custkey").alias("customer"))
        .agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("amount"))
    )
    # Totals are a row for each brand, joined back: a window would gather a hot brand in one task.
    totals = amounts.groupBy("brand").agg(F.sum("amount").alias("total"), F.count("customer").alias("customers"))
    return amounts.join(totals, "brand").select("brand", "customer", "amount", F.round(F.col("amount") / F.nullif("total", F.lit(0.0)), 8).alias("share"), "customers")


@R.query(
    "spend_share_of_year",
    """WITH a AS (SELECT s_nationkey AS nation, strftime(CAST(l_shipdate AS DATE), '%Y') AS year, round(sum(l_extendedprice), 2) AS spend FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)
       SELECT nation, year, spend, round(100 * spend / nullif(sum(spend) OVER (PARTITION BY year), 0), 4) AS percent FROM a""",
)
def spend_share(spark, sf_dir):
    line, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    spend = (
        line.join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
        .groupBy(F.col("s_nationkey").alias("nation"), F.date_format(F.col("l_shipdate").cast("date"), "yyyy").alias("year"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("spend"))
    )  # one row for each nation and year, so the window is small
    year = Window.partitionBy("year")
    return spend.withColumn("percent", F.round(100 * F.col("spend") / F.nullif(F.sum("spend").over(year), F.lit(0.0)), 4))


@R.query(
    "category_merge_rule",
    f"""SELECT CASE WHEN l_returnflag IN ('A', 'R') THEN 'returned' ELSE l_returnflag END AS flag, {MONTH} AS period, round(sum({NET}), 4) AS order_amount FROM {OLI} GROUP BY 1, 2""",
)
def merge_rule(spark, sf_dir):
    return ask(spark, sf_dir, metrics=("order_amount",), dimensions=("flag",), period="month", merges=(("flag", ("A", "R"), "returned"),))


@R.query("metric_topn", f"SELECT o_custkey AS customer, round(sum(o_totalprice), 2) AS order_total FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def topn(spark, sf_dir):
    totals = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.round(F.sum("o_totalprice"), 2).alias("order_total"))
    return totals.orderBy(F.desc_nulls_last("order_total"), "customer").limit(clamp(25, 100, 1000))
