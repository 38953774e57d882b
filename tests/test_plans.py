from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.plans import guards, questions, steps
from quarry.plans.catalog import AS_OF, CATALOG
from quarry.plans.compiler import compile_plan, joined
from quarry.plans.model import AnalysisPlan, PlanError, TimeRange
from quarry.plans.scope import AccessScope, masked, scoped
from quarry.plans.windows import bounds, shift
from quarry.sources.tables import table


def tables(spark, sf_dir):
    return lambda name: table(spark, sf_dir, name)


@pytest.mark.parametrize(
    "plan",
    [
        AnalysisPlan(metrics=()),
        AnalysisPlan(metrics=("no_such",)),
        AnalysisPlan(metrics=("order_total",), dimensions=("category",)),
        AnalysisPlan(metrics=("order_total", "order_amount")),
        AnalysisPlan(metrics=("order_total",), dimensions=("status",), filters=(("status", ()),)),
        AnalysisPlan(metrics=("order_total",), dimensions=("status",), filters=(("status", ("",)),)),
        AnalysisPlan(metrics=("order_total",), dimensions=("status",), order_by="order_count"),
        AnalysisPlan(metrics=("prorated_amount",), dimensions=("segment",)),
        AnalysisPlan(metrics=("order_total",), dimensions=("status",), comparison="week", time=TimeRange("current_year")),
    ],
)
def test_bad_plans_fail(spark, sf_dir, plan):
    with pytest.raises(PlanError):
        compile_plan(tables(spark, sf_dir), CATALOG, plan, AS_OF)


def test_windows():
    day = date(2001, 8, 1)
    assert bounds(TimeRange("current_year"), day) == (date(2001, 1, 1), date(2002, 1, 1))
    assert bounds(TimeRange("current_year"), day, comparing=True) == (date(2001, 1, 1), date(2001, 8, 2))
    assert bounds(TimeRange("complete_months", count=3), day) == (date(2001, 5, 1), date(2001, 8, 1))
    assert bounds(TimeRange("month", value="2000-12"), day) == (date(2000, 12, 1), date(2001, 1, 1))
    assert shift(date(2000, 2, 29), -12) == date(1999, 2, 28)
    with pytest.raises(PlanError):
        bounds(TimeRange("someday"), day)


@given(st.dates(date(1990, 1, 1), date(2100, 1, 1)), st.integers(-40, 40))
@settings(max_examples=100)
def test_shift_keeps_the_month(day, n):
    moved = shift(day, n)
    assert (moved.year * 12 + moved.month) - (day.year * 12 + day.month) == n and moved.day <= day.day


def test_only_needed_tables_are_joined(spark, sf_dir):
    plan = joined(tables(spark, sf_dir), "lineitem", ["supplier"])._jdf.queryExecution().optimizedPlan().toString()
    assert "customer" not in plan and "s_suppkey" in plan
    with pytest.raises(PlanError):
        joined(tables(spark, sf_dir), "region", ["part"])


def test_filters_reach_the_scan(spark, sf_dir):
    plan = AnalysisPlan(metrics=("order_total",), dimensions=("status",), filters=(("status", ("O",)),))
    text = compile_plan(tables(spark, sf_dir), CATALOG, plan, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,O)" in text and "o_orderpriority" not in text


def test_steps(spark):
    anchor = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    side = spark.createDataFrame([("a ", 10), ("b", 20)], "k string, v int")
    rich = {r.k: (r.v, r.v_2) for r in steps.attach(anchor, side, ["k"]).collect()}
    assert rich == {"a": (1, 10), "b": (2, 20), "c": (3, None)}
    assert steps.attach(anchor, side, ["k"], "filter").count() == 2
    assert steps.coverage(anchor, side.where("v = 20"), ["k"]).first().asDict() == {"anchor": 3, "matched": 1, "unmatched": 2, "rate": 0.333333}
    assert steps.coverage(anchor.limit(0), side, ["k"]).first().rate is None
    for bad in ([("a", 1), ("a", 2)], [(None, 1)], [(" ", 1)]):
        with pytest.raises(Exception, match="join key"):
            steps.attach(anchor, spark.createDataFrame(bad, "k string, w int"), ["k"]).collect()


def test_step_graph():
    plan = AnalysisPlan(metrics=("order_total",), dimensions=("status",))
    a, b = steps.Step("a", plan, ("status",)), steps.Step("b", plan, ("status",), depends_on=("a",))
    assert [s.id for s in steps.ordered([b, a])] == ["a", "b"]
    with pytest.raises(PlanError):
        steps.ordered([steps.Step("a", plan, ("status",), depends_on=("b",)), b])
    with pytest.raises(PlanError):
        steps.ordered([steps.Step(str(i), plan, ("status",)) for i in range(9)])
    other = steps.Step("c", AnalysisPlan(metrics=("order_count",), dimensions=("status",)), ("status",))
    assert steps.merged([a, other])[0].plan.metrics == ("order_total", "order_count")


def test_scope(spark, sf_dir):
    scope = AccessScope(tenants=("ASIA",))
    assert 0 < scoped(spark, sf_dir, "lineitem", scope).count() < table(spark, sf_dir, "lineitem").count()
    for name, s in (("events", scope), ("orders", AccessScope(tenants=())), ("orders", AccessScope(restricted=frozenset({"orders"})))):
        with pytest.raises(PlanError):
            scoped(spark, sf_dir, name, s)
    with pytest.raises(PlanError):
        scope.check(("EUROPE",))


def test_masking_twice_is_masking_once(spark):
    df = spark.createDataFrame([("ab", 1.0), ("abc", 2.0), ("a very long name", 3.0), (None, 4.0), ("", 5.0)], "c_name string, total double")
    scope = AccessScope(finance=False, persons=False)
    once = masked(df, scope)
    assert [tuple(r) for r in once.collect()] == [("**", None), ("a*c", None), ("a******e", None), (None, None), ("**", None)]
    assert masked(once, scope).collect() == once.collect()


def test_guards(spark, sf_dir):
    known = {"orders": table(spark, sf_dir, "orders")}
    ok = guards.guarded(spark, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey > :k GROUP BY 1", known, {"k": 5}, tenant="o_orderstatus")
    assert ok.count() > 0
    assert guards.guarded(spark, "SELECT o_orderkey FROM orders", known, most=7).count() == 7
    for sql in ("DROP TABLE orders", "SELECT 1; SELECT 2", "SELECT * FROM customer", "SELECT * FROM orders WHERE 1 = (DELETE FROM orders)"):
        with pytest.raises(PlanError):
            guards.guarded(spark, sql, known)
    with pytest.raises(PlanError):
        guards.guarded(spark, "SELECT o_orderkey FROM orders", known, tenant="company")
    with pytest.raises(Exception, match="no_such"):
        guards.guarded(spark, "SELECT no_such FROM orders", known)
    assert {c["key"]: c["dataType"] for c in guards.columns(known["orders"])}["o_totalprice"] == "money"


def test_questions():
    plan = questions.plan_for("top 5 sales by month in the last 3 complete months", AS_OF)
    assert plan.metrics == ("order_amount",) and plan.limit == 5 and plan.period == "month" and plan.time == TimeRange("complete_months", count=3)
    with pytest.raises(PlanError):
        questions.plan_for("what is the weather", AS_OF)


@pytest.fixture
def hidden(spark):
    spark.createDataFrame([(9, "secret")], "id int, v string").createOrReplaceTempView("hidden")
    yield
    spark.catalog.dropTempView("hidden")


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT t.id FROM t, hidden",
        "SELECT * FROM t JOIN `hidden`",
        "SELECT (SELECT count(*) FROM`hidden`) AS n FROM t",
        "SELECT * FROM `parquet`.`/root/testdata/sf0.001/region.parquet`",
        "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`",
        "WITH c AS (SELECT * FROM hidden) SELECT * FROM c",
        "SELECT * FROM hidden WHERE 1 = (WITH hidden AS (SELECT 1 AS z) SELECT z FROM hidden)",
        "SELECT id FROM t WHERE EXISTS (SELECT 1 FROM hidden)",
        "SELECT id FROM t WHERE id IN (SELECT id FROM hidden)",
        "SELECT * FROM t, LATERAL (SELECT * FROM hidden)",
        "SELECT * FROM t UNION ALL TABLE hidden",
        "SELECT * FROM range(5)",
        "SELECT id FROM t; SELECT 1",
        "SELECT reflect('java.lang.System', 'getenv') FROM t",
    ],
)
def test_guards_read_only_what_they_are_given(spark, hidden, sql):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    with pytest.raises(PlanError):
        guards.guarded(spark, sql, {"t": t})


def test_guards_scope_and_limits(spark, hidden):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    spark.createDataFrame([(7,)], "mine int").createOrReplaceTempView("t")
    run = lambda sql, **k: sorted(map(tuple, guards.guarded(spark, sql, {"t": t}, **k).collect()))
    assert run("WITH c AS (SELECT * FROM t), d AS (SELECT * FROM c) SELECT id FROM d") == [(1,), (2,)]
    assert run("SELECT id FROM t ORDER BY id;") == [(1,), (2,)] and run("SELECT 1 AS x") == [(1,)]
    assert spark.table("t").columns == ["mine"]  # the caller's view is still there
    spark.catalog.dropTempView("t")
    guards.guarded(spark, "SELECT id FROM t", {"t": t})
    assert not spark.catalog.tableExists("t")
    # A limit holds but for queries that are aggregates themselves, and the tenant's column is the table's.
    assert len(run("SELECT id, (SELECT count(*) FROM t) AS n FROM t", most=1)) == 1
    assert len(run("SELECT v, count(*) AS n FROM t GROUP BY v ORDER BY v", most=1)) == 2
    assert run("SELECT v, count(*) AS n FROM t GROUP BY v", tenant="v") == [("a", 1), ("b", 1)]
    for sql in ("SELECT id, 'a' AS v FROM t", "SELECT id FROM t", "SELECT id, v FROM t UNION ALL SELECT id, 'x' FROM t"):
        with pytest.raises(PlanError):
            run(sql, tenant="v")
