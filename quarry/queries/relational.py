"""Joins, aggregates, windows, limits, set operations and upserts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import relational as op
from quarry.plans import steps as st
from quarry.plans.catalog import AS_OF, CATALOG
from quarry.plans.compiler import compile_plan, joined
from quarry.plans.model import AnalysisPlan
from quarry.plans.scope import AccessScope, masked, scoped
from quarry.queries.registry import Registry
from quarry.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
NET = "l_extendedprice * (1 - l_discount)"


def tables(spark, sf_dir):
    return lambda name: table(spark, sf_dir, name)


# Steps and key filters


@R.query("tuple_semi_filter", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE (o_orderstatus, o_orderpriority) IN (('O', '1-URGENT'), ('F', '2-HIGH'), ('P', '5-LOW'))")
def tuple_filter(spark, sf_dir):
    keep = spark.createDataFrame([("O", "1-URGENT"), ("F", "2-HIGH"), ("P", "5-LOW")], "o_orderstatus string, o_orderpriority string")
    return table(spark, sf_dir, "orders").join(F.broadcast(keep), ["o_orderstatus", "o_orderpriority"], "left_semi").select("o_orderkey", "o_orderstatus", "o_orderpriority")


@R.query("set_filter", "SELECT p_brand AS brand, sum(l_quantity) AS order_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE p_brand IN ('Brand#11', 'Brand#23', 'Brand#45') GROUP BY 1")
def set_filter(spark, sf_dir):
    plan = AnalysisPlan(metrics=("order_quantity",), dimensions=("brand",), filters=(("brand", ("Brand#11", "Brand#23", "Brand#45")),))
    return compile_plan(tables(spark, sf_dir), CATALOG, plan, AS_OF)


def _steps(spark, sf_dir, mode):
    first = st.Step("spend", AnalysisPlan(metrics=("order_quantity",), dimensions=("supplier",), below=(("order_quantity", 16000),)), ("supplier",))
    second = st.Step("returns", AnalysisPlan(metrics=("discount_rate",), dimensions=("supplier",), filters=(("flag", ("R",)),)), ("supplier",), mode, ("spend",))
    return st.run([first, second], lambda plan, keep: compile_plan(tables(spark, sf_dir), CATALOG, plan, AS_OF, keep))


_STEP_SQL = """WITH a AS (SELECT s_name AS supplier, sum(l_quantity) AS order_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1 HAVING sum(l_quantity) < 16000),
    b AS (SELECT s_name AS supplier, round(sum(l_extendedprice * l_discount) / nullif(sum(l_extendedprice), 0), 6) AS discount_rate
          FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT supplier, order_quantity, discount_rate FROM a {join} JOIN b USING (supplier)"""


@R.query("step_enrich_join", _STEP_SQL.format(join="LEFT"))
def enrich(spark, sf_dir):
    return _steps(spark, sf_dir, "enrich")


@R.query("step_filter_join", _STEP_SQL.format(join=""))
def filter_join(spark, sf_dir):
    return _steps(spark, sf_dir, "filter")


@R.query(
    "step_coverage",
    """WITH a AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 500), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
       SELECT count(*) AS anchor, count(o_custkey) AS matched, count(*) - count(o_custkey) AS unmatched, round(count(o_custkey) / nullif(count(*), 0), 6) AS rate FROM a LEFT JOIN b ON o_custkey = c_custkey""",
)
def coverage(spark, sf_dir):
    anchor = table(spark, sf_dir, "customer").where("c_acctbal > 0").orderBy(F.desc("c_acctbal"), "c_custkey").limit(500).select("c_custkey")
    step = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return st.coverage(anchor, step, ["c_custkey"])


# Joins


@R.query(
    "detail_star_join",
    """SELECT l_orderkey, l_linenumber, c_name, p_brand, s_name, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey
       LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderpriority = '1-URGENT' AND l_returnflag = 'R'""",
)
def star(spark, sf_dir, priority="1-URGENT", only_returned=True):
    line, orders, customer, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part", "supplier"))
    if priority is not None:  # a predicate is there only if its parameter is bound
        orders = orders.where(F.col("o_orderpriority") == priority)
    if only_returned:
        line = line.where(F.col("l_returnflag") == "R")
    return (
        line.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(customer, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(part, F.col("p_partkey") == F.col("l_partkey"), "left")
        .join(supplier, F.col("s_suppkey") == F.col("l_suppkey"), "left")
        .select("l_orderkey", "l_linenumber", "c_name", "p_brand", "s_name", "l_quantity")
    )


@R.query("knowledge_join_path", "SELECT r_name, count(*) AS lines FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def join_path(spark, sf_dir):
    return joined(tables(spark, sf_dir), "lineitem", ["region"]).groupBy("r_name").agg(F.count("*").alias("lines"))


@R.query(
    "preagg_left_join",
    "SELECT o_orderkey, o_totalprice, q.quantity, q.lines FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS quantity, count(*) AS lines FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) q ON l_orderkey = o_orderkey",
)
def preagg(spark, sf_dir):
    received = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("lines"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(received, "o_orderkey", "left")


@R.query(
    "net_requirement",
    """WITH stock AS (SELECT l_partkey AS part, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
        open AS (SELECT l_partkey AS part, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'A' GROUP BY 1),
        src AS (SELECT l_partkey AS part, l_suppkey AS area, sum(l_quantity) * 3 AS balance FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2)
        SELECT part, area, greatest(0, balance - coalesce(stock.q, 0) - coalesce(open.q, 0)) AS net FROM src LEFT JOIN stock USING (part) LEFT JOIN open USING (part)""",
)
def net_requirement(spark, sf_dir):
    """What is left of each source row's balance after stock and open orders; both count for every source row, as nothing is allocated."""
    line = table(spark, sf_dir, "lineitem").withColumn("part", F.col("l_partkey"))
    stock = line.where("l_returnflag = 'R'").groupBy("part").agg(F.sum("l_quantity").alias("stock"))
    open_ = line.where("l_linestatus = 'O' AND l_returnflag = 'A'").groupBy("part").agg(F.sum("l_quantity").alias("open"))
    source = line.where("l_returnflag = 'N'").groupBy("part", F.col("l_suppkey").alias("area")).agg((F.sum("l_quantity") * 3).alias("balance"))
    left = F.col("balance") - F.coalesce("stock", F.lit(0.0)) - F.coalesce("open", F.lit(0.0))
    return source.join(stock, "part", "left").join(open_, "part", "left").select("part", "area", F.greatest(F.lit(0.0), left).alias("net"))


@R.query(
    "vendor_order_groups",
    """WITH d AS (SELECT s_name AS vendor, l_partkey, l_quantity, row_number() OVER (PARTITION BY s_name ORDER BY l_partkey, l_quantity, l_orderkey, l_linenumber) - 1 AS place FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' AND l_quantity >= 40),
            t AS (SELECT vendor, count(*) AS lines, sum(l_quantity) AS quantity FROM d GROUP BY 1)
       SELECT vendor, CAST(place // 5 AS BIGINT) AS page, any_value(lines) AS lines, any_value(quantity) AS quantity, to_json(list({'part': l_partkey, 'quantity': l_quantity} ORDER BY place)) AS details FROM d JOIN t USING (vendor) GROUP BY 1, 2""",
)
def vendor_groups(spark, sf_dir):
    """Each vendor's order with its details nested, five on a page, so that no row grows with the vendor."""
    line = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 40")
    both = line.join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_name").alias("vendor"), "l_partkey", "l_quantity", "l_orderkey", "l_linenumber")
    totals = both.groupBy("vendor").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    place = F.row_number().over(Window.partitionBy("vendor").orderBy("l_partkey", "l_quantity", "l_orderkey", "l_linenumber")) - 1
    paged = both.withColumn("place", place).withColumn("page", F.floor(F.col("place") / 5))
    shown = F.transform(F.sort_array(F.collect_list(F.struct("place", "l_partkey", "l_quantity"))), lambda d: F.struct(d["l_partkey"].alias("part"), d["l_quantity"].alias("quantity")))
    return paged.groupBy("vendor", "page").agg(F.to_json(shown).alias("details")).join(totals, "vendor").select("vendor", "page", "lines", "quantity", "details")


@R.query(
    "lateral_latest_line",
    """SELECT o_orderkey, l.l_shipdate AS last_ship, l.l_partkey AS last_part FROM orders LEFT JOIN LATERAL
       (SELECT l_shipdate, l_partkey FROM lineitem WHERE l_orderkey = o_orderkey ORDER BY l_shipdate DESC, l_partkey DESC LIMIT 1) l ON true WHERE o_orderpriority = '5-LOW'""",
)
def lateral(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '5-LOW'").select("o_orderkey")
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.struct("l_shipdate", "l_partkey")).alias("l"))
    return orders.join(last, "o_orderkey", "left").select("o_orderkey", F.col("l.l_shipdate").alias("last_ship"), F.col("l.l_partkey").alias("last_part"))


@R.query("distinct_on_latest", "SELECT DISTINCT ON (user_id) user_id, event_id, event_type, value FROM events ORDER BY user_id, ts DESC, event_id DESC")
def distinct_on(spark, sf_dir):
    return op.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], "ts", "event_id").drop("ts")


@R.query(
    "keep_best_row",
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, ts DESC, event_id) AS r FROM events) WHERE r = 1""",
)
def keep_best(spark, sf_dir):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return op.keep_best(events, ["user_id"], rank.alias("a"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("b"), F.col("event_id").alias("c")).drop("ts")


@R.query("exists_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def exists_semi(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@R.query("exists_flag", "SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) AS toxic FROM documents d")
def exists_flag(spark, sf_dir):
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("found", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id").join(toxic, "doc_id", "left").select("doc_id", F.col("found").isNotNull().alias("toxic"))


@R.query("anti_missing", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@R.query(
    "pattern_theta_join",
    "WITH p(name, pattern) AS (VALUES ('apache', 'apache license'), ('mit', 'mit license'), ('mail', '@')) SELECT name, count(*) AS documents FROM documents JOIN p ON contains(lower(text), pattern) GROUP BY 1",
)
def pattern_join(spark, sf_dir):
    """A short list of patterns against all texts: each text makes the list of those it holds, without a join."""
    patterns = (("apache", "apache license"), ("mit", "mit license"), ("mail", "@"))
    lowered = F.lower("text")
    names = F.array_compact(F.array(*[F.when(lowered.contains(p), n) for n, p in patterns]))
    return table(spark, sf_dir, "documents").select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("documents"))


@R.query("any_pattern_filter", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%green%' OR lower(p_name) LIKE '%1%' OR contains(lower(p_name), '_')")
def any_pattern(spark, sf_dir):
    name = F.lower("p_name")
    return table(spark, sf_dir, "part").where(F.exists(F.array(*[F.lit(p) for p in ("green", "1", "_")]), lambda p: name.contains(p))).select("p_partkey", "p_name")


@R.query(
    "followup_interval_join",
    """SELECT a.event_id, count(*) AS followups FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE WHERE a.event_type = 'view' GROUP BY 1""",
)
def followups(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    right = events.select(F.col("user_id"), F.col("ts").alias("later"))
    return op.interval_join(left, right, "user_id", "ts", "later", 30 * 60).groupBy("event_id").agg(F.count("*").alias("followups"))


@R.query("using_join", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def using(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality")


@R.query(
    "category_rule_division",
    """WITH own AS (SELECT l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#14') GROUP BY 1 HAVING count(DISTINCT p_brand) = 4)
       SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM own)""",
)
def division(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_suppkey", "p_brand")
    own = op.owners_of_all(pairs, "l_suppkey", "p_brand", ["Brand#11", "Brand#12", "Brand#13", "Brand#14"])
    return table(spark, sf_dir, "supplier").join(own, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


@R.query(
    "precedence_lookup",
    """WITH q AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN ' ' || s_name || ' ' WHEN 2 THEN upper(s_name) ELSE replace(lower(s_name), '#', '--') END AS name FROM supplier),
        h AS (SELECT k, s_suppkey AS m, 1 AS rung FROM q JOIN supplier ON name = s_name UNION ALL SELECT k, s_suppkey, 2 FROM q JOIN supplier ON trim(name) = trim(s_name)
        UNION ALL SELECT k, s_suppkey, 3 FROM q JOIN supplier ON lower(trim(name)) = lower(trim(s_name))
        UNION ALL SELECT k, s_suppkey, 4 FROM q JOIN supplier ON regexp_replace(lower(name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g'))
        SELECT k, m AS s_suppkey, rung FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rung, m) AS r FROM h) WHERE r = 1""",
)
def ladder(spark, sf_dir):
    master = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    r = F.col("k") % 4
    name = F.when(r == 0, F.col("s_name")).when(r == 1, F.concat(F.lit(" "), "s_name", F.lit(" "))).when(r == 2, F.upper("s_name")).otherwise(F.replace(F.lower("s_name"), F.lit("#"), F.lit("--")))
    asked = table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey")).select("k", name.alias("name"))
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    rungs = [(f(F.col("name")), f(F.col("s_name"))) for f in (lambda c: c, F.trim, lambda c: F.lower(F.trim(c)), bare)]
    return op.ladder_lookup(asked, master, rungs, "k", "s_suppkey")


@R.query(
    "update_from_values",
    "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'Brand#00' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 20 = 0 THEN 1 ELSE p_size END AS p_size FROM part",
)
def update_values(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    updates = part.where("p_partkey % 10 = 0").select("p_partkey", F.lit("Brand#00").alias("p_brand"), F.when(F.col("p_partkey") % 20 == 0, 1).alias("p_size"))
    return op.update_from(part, updates, "p_partkey", ["p_brand", "p_size"])


@R.query(
    "first_row_join",
    """SELECT c_custkey, o_orderkey AS first_order, o_orderdate AS first_date FROM customer LEFT JOIN (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey) ON o_custkey = c_custkey""",
)
def first_row(spark, sf_dir):
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("f"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(first, "c_custkey", "left").select("c_custkey", F.col("f.o_orderkey").alias("first_order"), F.col("f.o_orderdate").alias("first_date"))


@R.query(
    "peer_pairs",
    """WITH x AS (SELECT o_orderkey AS k, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)
       SELECT a.k, count(*) AS pairs, sum(b.p - a.p) AS spread FROM x a JOIN x b ON a.k = b.k AND a.p < b.p GROUP BY 1""",
)
def peers(spark, sf_dir):
    """Statistics over all pairs within an order from its sorted members: the i-th of n is larger in i pairs and smaller in n - 1 - i."""
    x = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    members = x.groupBy(F.col("o_orderkey").alias("k")).agg(F.array_sort(F.collect_set("l_partkey")).alias("p")).where(F.size("p") > 1)
    n = F.size("p")
    spread = F.aggregate(F.transform("p", lambda v, i: v * (2 * i - (n - 1))), F.lit(0).cast("long"), lambda a, v: a + v)
    return members.select("k", (n * (n - 1) / 2).cast("long").alias("pairs"), spread.alias("spread"))


@R.query(
    "ledger_join",
    """WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1), c AS (SELECT conv_id AS doc_id, count(*) AS turns FROM conversations GROUP BY 1), p AS (SELECT page_id AS doc_id, min(url) AS url FROM pages GROUP BY 1)
       SELECT d.doc_id, d.lang, quality, toxic, coalesce(turns, 0) AS turns, url FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN p USING (doc_id)""",
)
def ledger(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("turns"))
    urls = table(spark, sf_dir, "pages").groupBy(F.col("page_id").alias("doc_id")).agg(F.min("url").alias("url"))
    df = table(spark, sf_dir, "documents").select("doc_id", "lang")
    for side in (labels, turns, urls):
        df = df.join(side, "doc_id", "left")
    return df.withColumn("turns", F.coalesce("turns", F.lit(0)))


# Scope


@R.query("scoped_rows", "SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def scoped_rows(spark, sf_dir):
    return scoped(spark, sf_dir, "orders", AccessScope(tenants=("ASIA", "EUROPE"))).select("o_orderkey", "o_totalprice")


@R.query(
    "masked_columns",
    """SELECT c_custkey, CASE WHEN length(c_name) <= 2 THEN '**' ELSE left(c_name, 1) || repeat('*', least(6, length(c_name) - 2)) || right(c_name, 1) END AS c_name, CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer""",
)
def masked_columns(spark, sf_dir):
    return masked(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), AccessScope(finance=False, persons=False))


@R.query("scope_literal_check", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY 1")
def literal_check(spark, sf_dir):
    scope = AccessScope(tenants=("ASIA", "EUROPE"))
    scope.check(("ASIA",))
    customers = scoped(spark, sf_dir, "customer", AccessScope(tenants=("ASIA",)))
    return customers.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers"))


# Filters


@R.query("null_safe_filter", "SELECT count(*) AS changed FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM 1")
def null_safe(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return both.where(~F.col("quality").eqNullSafe(1)).agg(F.count("*").alias("changed"))


@R.query("regex_filter", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '(?i)^(small|large).*steel')")
def regex_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_type").rlike("(?i)^(small|large).*steel")).select("p_partkey", "p_type")


@R.query("ui_filter", "SELECT p_partkey, p_name, p_size FROM part WHERE contains(lower(p_name), '1') AND p_brand = 'Brand#12' AND p_size BETWEEN 5 AND 30")
def ui_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.lower("p_name").contains("1") & (F.col("p_brand") == "Brand#12") & F.col("p_size").between(5, 30)).select("p_partkey", "p_name", "p_size")


@R.query("master_detail", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9900))")
def master_detail(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").where("c_acctbal > 9900")
    heads = table(spark, sf_dir, "orders").join(chosen, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return table(spark, sf_dir, "lineitem").join(heads, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@R.query("tag_filter", "SELECT doc_id FROM documents WHERE list_has_any(string_split(lang || ',' || source, ','), ['de', 'src3'])")
def tag_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.arrays_overlap(F.array("lang", "source"), F.array(F.lit("de"), F.lit("src3")))).select("doc_id")


@R.query("config_lookup", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), '12') AND coalesce(p_brand, '') <> 'Brand#11' ORDER BY p_partkey DESC LIMIT 20")
def config_lookup(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.lower("p_name").contains("12") & (F.coalesce("p_brand", F.lit("")) != "Brand#11")).orderBy(F.desc("p_partkey")).limit(20).select("p_partkey", "p_name")


# Aggregates


@R.query(
    "count_filter_flags",
    """SELECT count(*) AS n, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (value IS NULL) AS no_value, count(*) FILTER (value > 50) AS large, count(DISTINCT user_id) AS users FROM events""",
)
def count_flags(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "events").agg(
        F.count("*").alias("n"), F.count_if(c("event_type") == "view").alias("views"), F.count_if(c("event_type") == "purchase").alias("purchases"),
        F.count_if(c("value").isNull()).alias("no_value"), F.count_if(c("value") > 50).alias("large"), F.count_distinct("user_id").alias("users"),
    )


@R.query("duplicate_groups", "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@R.query("ordered_collect", "SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS path FROM events WHERE event_type <> 'view' GROUP BY 1")
def ordered_collect(spark, sf_dir):
    path = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    return table(spark, sf_dir, "events").where("event_type <> 'view'").groupBy("user_id").agg(F.array_join(path, ">").alias("path"))


@R.query("band_histogram", "SELECT (doc_id - 1) // 100 * 100 + 1 AS band, count(*) AS n, count(*) FILTER (lang = 'en') AS english FROM documents WHERE doc_id >= 1 GROUP BY 1")
def bands(spark, sf_dir):
    band = (F.floor((F.col("doc_id") - 1) / 100) * 100 + 1).alias("band")
    return table(spark, sf_dir, "documents").where("doc_id >= 1").groupBy(band).agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("english"))


@R.query("top_counts", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 10")
def top_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@R.query("explode_counts", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) GROUP BY 1")
def explode_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@R.query(
    "family_groups",
    """SELECT p_brand AS family, count(*) AS n, count(DISTINCT p_type) AS types, arg_min(p_partkey, struct_pack(a := -p_retailprice, b := p_size, c := p_partkey)) AS representative,
       array_to_string(list_sort(list(DISTINCT p_type))[1:20], '|') AS sample FROM part GROUP BY 1""",
)
def families(spark, sf_dir):
    best = F.min_by("p_partkey", F.struct((-F.col("p_retailprice")).alias("a"), F.col("p_size").alias("b"), F.col("p_partkey").alias("c")))
    sample = F.array_join(F.slice(F.array_sort(F.collect_set("p_type")), 1, 20), "|")
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("family")).agg(F.count("*").alias("n"), F.count_distinct("p_type").alias("types"), best.alias("representative"), sample.alias("sample"))


@R.query("desc_count_by_key", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2 ORDER BY n DESC, lang, source")
def desc_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang", "source")


@R.query("status_group_count", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@R.query(
    "group_with_samples",
    """SELECT source, lang, count(*) AS n, count(*) FILTER (n_chars > 1000) AS long, array_to_string(list(doc_id ORDER BY doc_id)[1:5], ',') AS samples FROM documents GROUP BY 1, 2""",
)
def group_samples(spark, sf_dir):
    """Samples come from a rank that is pruned before the shuffle; counts from an aggregate."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    first = docs.withColumn("r", F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id"))).where("r <= 5")
    samples = first.groupBy("source", "lang").agg(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",").alias("samples"))
    return docs.groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("long")).join(samples, ["source", "lang"])


@R.query("corpus_summary", "SELECT count(*) AS total, count(DISTINCT text) AS distinct_texts, count(*) - count(DISTINCT text) AS duplicates, count(*) FILTER (contains(text, '|')) AS tabular FROM documents")
def summary(spark, sf_dir):
    hash_ = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("total"), F.count_distinct(hash_).alias("distinct_texts"), (F.count("*") - F.count_distinct(hash_)).alias("duplicates"), F.count_if(F.col("text").contains("|")).alias("tabular"))


@R.query(
    "cluster_candidates",
    """SELECT p_type AS term, count(*) AS occurrences, count(DISTINCT p_brand) AS documents, max(p_retailprice) AS most, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS brands FROM part GROUP BY 1""",
)
def clusters(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("term")).agg(
        F.count("*").alias("occurrences"), F.count_distinct("p_brand").alias("documents"), F.max("p_retailprice").alias("most"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands")
    )


@R.query(
    "content_hash_dedupe",
    """WITH h AS (SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS hash, CASE WHEN quality = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS rank FROM documents LEFT JOIN labels USING (doc_id))
       SELECT hash, arg_min(doc_id, struct_pack(r := rank, d := doc_id)) AS canonical, count(*) AS copies FROM h GROUP BY 1 HAVING count(*) > 1""",
)
def content_dedupe(spark, sf_dir):
    rank = F.when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.replace("text", F.lit("\r\n"), F.lit("\n")), 256).alias("hash"))
    both = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.groupBy("hash").agg(F.min_by("doc_id", F.struct(rank.alias("r"), F.col("doc_id").alias("d"))).alias("canonical"), F.count("*").alias("copies")).where("copies > 1")


@R.query(
    "gap_unpivot_counts",
    """SELECT gap, sum(missing) AS missing FROM (SELECT unnest(['quality', 'toxic', 'lang', 'url']) AS gap, unnest([(quality IS NULL)::INT, (toxic IS NULL)::INT, (lang IS NULL)::INT, (url IS NULL)::INT]) AS missing
       FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN pages ON page_id = d.doc_id) GROUP BY 1""",
)
def gaps(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    both = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left").join(pages, "doc_id", "left")
    counts = both.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("quality", "toxic", "lang", "url")])
    return counts.unpivot([], ["quality", "toxic", "lang", "url"], "gap", "missing")


@R.query("scalar_multi_count", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, (SELECT count(*) FROM documents WHERE lang = 'de') AS german, (SELECT count(*) FROM pages) AS pages")
def multi_count(spark, sf_dir):
    t = tables(spark, sf_dir)
    one = [t("orders").agg(F.count("*").alias("orders")), t("events").where("event_type = 'error'").agg(F.count("*").alias("errors")), t("documents").where("lang = 'de'").agg(F.count("*").alias("german")), t("pages").agg(F.count("*").alias("pages"))]
    return one[0].join(one[1], how="cross").join(one[2], how="cross").join(one[3], how="cross")  # one row each


@R.query(
    "rollup_status",
    """SELECT o_custkey AS package, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'partial' WHEN bool_and(o_orderstatus = 'F') THEN 'done' WHEN bool_or(o_orderstatus = 'F') THEN 'started' ELSE 'open' END AS status FROM orders GROUP BY 1""",
)
def rollup(spark, sf_dir):
    s = F.col("o_orderstatus")
    status = F.when(F.bool_or(s == "P"), "partial").when(F.bool_and(s == "F"), "done").when(F.bool_or(s == "F"), "started").otherwise("open")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("package")).agg(status.alias("status"))


@R.query(
    "multi_tag_groups",
    """WITH t AS (SELECT doc_id, CASE WHEN len(x) = 0 THEN ['untagged'] ELSE x END AS tags FROM (SELECT doc_id, list_filter([CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN n_chars > 5000 THEN 'long' END], lambda v: v IS NOT NULL) AS x FROM documents))
       SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM t) GROUP BY 1""",
)
def multi_tags(spark, sf_dir):
    tags = F.array_compact(F.array(F.when(F.col("text").contains("|"), "table"), F.when(F.col("text").contains("@"), "mail"), F.when(F.col("n_chars") > 5000, "long")))
    return table(spark, sf_dir, "documents").select(F.explode(F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("untagged")))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@R.query(
    "conservation_check",
    """SELECT 'orders' AS check_name, (SELECT count(*) FROM orders) = sum(n) AS ok FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) UNION ALL SELECT 'order keys', count(*) = count(DISTINCT o_orderkey) FROM orders""",
)
def conservation(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    total = orders.agg(F.count("*").alias("all"))
    by = orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).agg(F.sum("n").alias("s"))
    first = by.join(total, how="cross").select(F.lit("orders").alias("check_name"), (F.col("all") == F.col("s")).alias("ok"))  # one row each
    return first.unionByName(orders.agg((F.count("*") == F.count_distinct("o_orderkey")).alias("ok")).select(F.lit("order keys").alias("check_name"), "ok"))


@R.query("nearest_rank_quantile", "SELECT lang, list_sort(list(n_chars))[CAST(floor((count(*) - 1) * 0.9) AS BIGINT) + 1] AS quantile FROM documents GROUP BY 1")
def nearest_rank(spark, sf_dir):
    return op.nearest_rank(table(spark, sf_dir, "documents"), ["lang"], "n_chars", 0.9)


@R.query("length_buckets", "SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'middle' ELSE 'long' END AS bucket, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY 1")
def length_buckets(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").groupBy(F.when(n < 500, "short").when(n < 2000, "middle").otherwise("long").alias("bucket")).agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"))


# Limits, pages, samples


@R.query("hash_sample_quota", "SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY sha256('seed:' || doc_id), doc_id) AS INTEGER) AS rank FROM documents) WHERE rank <= 20")
def hash_quota(spark, sf_dir):
    return op.hash_quota(table(spark, sf_dir, "documents").select("lang", "doc_id"), "doc_id", "lang", 20, "seed")


@R.query("stratified_round_robin", "SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY sha256('robin:' || doc_id), doc_id) AS INTEGER) AS rank FROM documents) ORDER BY rank, lang LIMIT 50")
def robin(spark, sf_dir):
    return op.round_robin(table(spark, sf_dir, "documents").select("lang", "doc_id"), "doc_id", "lang", 50, "robin")


@R.query("page_with_total", "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def page(spark, sf_dir):
    return op.page(table(spark, sf_dir, "customer"), 40, 20, F.desc("c_acctbal"), "c_custkey").select("c_custkey", "c_name", "total")


@R.query("truncation_probe", "SELECT o_orderkey, true AS truncated FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500")
def truncation(spark, sf_dir):
    return op.probe(table(spark, sf_dir, "orders"), 500, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "truncated")


@R.query(
    "case_rank_lookup",
    """SELECT c_custkey, CASE WHEN lower(c_name) = 'customer#000000012' THEN 0 WHEN c_custkey = 12 THEN 1 WHEN starts_with(lower(c_name), 'customer#00000001') THEN 2 ELSE 3 END AS rank, c_name FROM customer WHERE contains(lower(c_name), '12') ORDER BY rank, length(c_name), c_custkey LIMIT 6""",
)
def case_rank(spark, sf_dir):
    name = F.lower("c_name")
    rank = F.when(name == "customer#000000012", 0).when(F.col("c_custkey") == 12, 1).when(name.startswith("customer#00000001"), 2).otherwise(3)
    return table(spark, sf_dir, "customer").where(name.contains("12")).select("c_custkey", rank.alias("rank"), "c_name").orderBy("rank", F.length("c_name"), "c_custkey").limit(6)


@R.query("hash_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha256('split:' || doc_id), doc_id) <= 280 THEN 'calibration' ELSE 'acceptance' END AS part FROM documents")
def hash_split(spark, sf_dir):
    """The 280 of least hash, found by a top-k; the rest needs no global order."""
    docs = table(spark, sf_dir, "documents").select("doc_id").withColumn("h", F.sha2(F.concat(F.lit("split:"), F.col("doc_id").cast("string")), 256))
    first = docs.orderBy("h", "doc_id").limit(280).groupBy(F.col("doc_id").alias("d")).agg(F.count("*").alias("n"))
    both = docs.join(F.broadcast(first), F.col("doc_id").eqNullSafe(F.col("d")), "left")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("h"))  # rows that repeat an id are taken one by one
    return both.withColumn("place", place).select("doc_id", F.when(F.col("place") <= F.col("n"), "calibration").otherwise("acceptance").alias("part"))


@R.query("priority_sample", "SELECT doc_id FROM ((SELECT doc_id FROM documents WHERE lang = 'de' ORDER BY n_chars DESC, doc_id LIMIT 30) UNION ALL (SELECT doc_id FROM documents WHERE lang <> 'de' ORDER BY n_chars DESC, doc_id LIMIT 70)) ORDER BY doc_id")
def priority_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    take = lambda df, n: df.orderBy(F.desc("n_chars"), "doc_id").limit(n).select("doc_id")
    return take(docs.where("lang = 'de'"), 30).unionByName(take(docs.where("lang <> 'de'"), 70)).orderBy("doc_id")


@R.query("cluster_sort", "SELECT source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY 1 ORDER BY n DESC, chars DESC, source")
def cluster_sort(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).orderBy(F.desc("n"), F.desc("chars"), "source")


@R.query("multi_key_rank", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 50")
def multi_key(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), F.desc("p_partkey")).limit(50).select("p_partkey", "p_retailprice")


@R.query("indexed_rows", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS idx FROM orders")
def indexed(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(w) - 1).alias("idx"))


# Sets


@R.query("union_three_sources", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT -item_id, text FROM benchmark UNION ALL SELECT -100000 - conv_id * 100 - turn, text FROM conversations")
def union_three(spark, sf_dir):
    t = tables(spark, sf_dir)
    return (
        t("documents").select(F.col("doc_id").alias("id"), "text")
        .unionByName(t("benchmark").select((-F.col("item_id")).alias("id"), "text"))
        .unionByName(t("conversations").select((F.lit(-100000) - F.col("conv_id") * 100 - F.col("turn")).alias("id"), "text"))
    )


@R.query("union_first_wins", "SELECT k, arg_min(name, pri) AS name FROM (SELECT n_nationkey AS k, n_name AS name, 2 AS pri FROM nation UNION ALL SELECT r_regionkey, r_name, 1 FROM region) GROUP BY 1")
def union_first(spark, sf_dir):
    t = tables(spark, sf_dir)
    both = t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.lit(2).alias("pri")).unionByName(t("region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.lit(1).alias("pri")))
    return both.groupBy("k").agg(F.min_by("name", "pri").alias("name"))


@R.query("set_difference", "SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def difference(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    pick = lambda p: orders.where(F.col("o_orderpriority") == p).select(F.col("o_custkey").alias("k"))
    return pick("1-URGENT").subtract(pick("5-LOW"))


@R.query("set_intersection", "SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def intersection(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    pick = lambda p: orders.where(F.col("o_orderpriority") == p).select(F.col("o_custkey").alias("k"))
    return pick("1-URGENT").intersect(pick("5-LOW"))


@R.query("folded_distinct", "SELECT lower(source) AS folded, arg_min(source, doc_id) AS first_form FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS source FROM documents) GROUP BY 1")
def folded(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")).alias("source"))
    return docs.groupBy(F.lower("source").alias("folded")).agg(F.min_by("source", "doc_id").alias("first_form"))


# State


@R.query(
    "event_state_upsert",
    """SELECT user_id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) FILTER (value IS NOT NULL AND event_type <> 'error') AS value, count(*) AS applied FROM events GROUP BY 1""",
)
def state_upsert(spark, sf_dir):
    """The state after all events in the order of arrival: status is overwritten, a value stays where a new one is null."""
    kept = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max_by("event_type", "event_id").alias("status"), F.max_by(kept, F.when(kept.isNotNull(), F.col("event_id"))).alias("value"), F.count("*").alias("applied")
    )


@R.query("idempotent_events", "SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, max(event_id) AS event_id FROM events GROUP BY 1, 2, 3")
def idempotent(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.col("ts").cast("date").cast("string").alias("day")).agg(F.max("event_id").alias("event_id"))


@R.query("queue_claim_order", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 25")
def queue_order(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(25).select("o_orderkey", "o_orderpriority")


@R.query(
    "upsert_last_wins",
    """WITH cur AS (SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) r FROM events) WHERE r = 1), new AS (SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events WHERE event_type = 'purchase') WHERE r = 1)
       SELECT * FROM new UNION ALL SELECT * FROM cur WHERE user_id NOT IN (SELECT user_id FROM new)""",
)
def upsert(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return op.upsert_last(op.keep_best(events, ["user_id"], F.col("event_id")), events.where("event_type = 'purchase'"), "user_id", "event_id")


@R.query(
    "insert_ignore",
    """WITH cur AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY 1), new AS (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1)
       SELECT * FROM cur UNION ALL SELECT * FROM new WHERE user_id NOT IN (SELECT user_id FROM cur)""",
)
def insert_ignore(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    current = table(spark, sf_dir, "events").where("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return op.insert_ignore(current, events, "user_id", F.col("event_id"))


@R.query("retention_delete", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-10' ORDER BY ts, event_id LIMIT 1000)")
def retention(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    doomed = events.where("ts < TIMESTAMP_NTZ '2024-01-10 00:00:00'").orderBy("ts", "event_id").limit(1000)
    return events.join(F.broadcast(doomed.select("event_id")), "event_id", "left_anti").select("event_id")


@R.query("event_log", "SELECT event_id, user_id, event_type || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS event_key FROM events")
def event_log(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.concat_ws(":", "event_type", F.col("ts").cast("date").cast("string")).alias("event_key"))


@R.query(
    "dirty_refresh",
    """WITH dirty AS (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-29') SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE user_id IN (SELECT user_id FROM dirty) GROUP BY 1""",
)
def dirty(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    changed = events.where("ts >= TIMESTAMP_NTZ '2024-01-29 00:00:00'").select("user_id").distinct()
    return events.join(changed, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@R.query(
    "restore_check",
    """WITH after AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS size FROM part) SELECT count(*) AS n, count(*) FILTER (p_size = size) AS restored, count(*) FILTER (p_size <> size) AS unrestored, bool_and(p_size = size) AS ok FROM part JOIN after USING (p_partkey)""",
)
def restore(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    after = part.select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("size"))
    same = F.col("p_size") == F.col("size")
    return part.join(after, "p_partkey").agg(F.count("*").alias("n"), F.count_if(same).alias("restored"), F.count_if(~same).alias("unrestored"), F.bool_and(same).alias("ok"))
