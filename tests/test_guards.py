"""Checks of SQL text by the resolved plan: what may run, where columns come from, and the rules of finance queries."""

import pytest

from quarry.plans.guards import Finance, Inspected, Reference, guarded
from quarry.plans.model import PlanError


@pytest.fixture(scope="module")
def given(spark):
    heads = spark.createDataFrame(
        [("a", 1, "2024-01-01", 1, 10.0), ("a", 2, "2024-02-01", 0, 20.0), ("b", 3, "2024-03-01", 1, 30.0)], "company string, invoicenum int, invoicedate string, posted int, docinvoiceamt double"
    )
    lines = spark.createDataFrame([("a", 1, 4.0), ("a", 1, 6.0), ("b", 3, 30.0)], "company string, invoicenum int, docextprice double")
    orders = spark.createDataFrame([("a", 9, "2024-01-05", "P")], "company string, ponum int, opendate string, posted string")
    return {"invchead": heads, "invcdtl": lines, "orderhed": orders}


@pytest.mark.parametrize(
    "sql",
    [
        "select try_reflect('java.lang.System','getProperty','user.home') from invchead",
        """select "'" a, reflect("java.lang.System","getProperty","user.home") x, "'" b from invchead""",
        "select java_method('java.lang.System','getProperty','user.home') from invchead",
        "select company from invchead where reflect('java.lang.System','getProperty','user.home') = 'x'",
        "select count(*) from invchead group by try_reflect('java.lang.System','getProperty','user.home')",
        "select sum(docinvoiceamt) over (order by try_reflect('java.lang.System','getProperty','user.home')) from invchead",
        "select (select try_reflect('java.lang.System','getProperty','user.home') from orderhed limit 1) x from invchead",
        "with c as (select reflect('java.lang.System','getProperty','user.home') x from invchead) select x from c",
        "select a.company from invchead a join orderhed b on a.company = try_reflect('java.lang.System','getProperty','user.home')",
        "select transform(array(1), x -> try_reflect('java.lang.System','getProperty','user.home')) from invchead",
        "select explode(array(1, 2)) from invchead",
        "select rand() from invchead", "select uuid() from invchead", "select input_file_name() from invchead", "select current_user() from invchead", "select raise_error('x') from invchead",
        "select assert_true(false) from invchead", "select monotonically_increasing_id() from invchead", "select version() from invchead", "select * from invchead tablesample (10 percent)",
        "update invchead set posted = 0", "delete from invchead", "drop table invchead", "select 1; select 2", "select company into t2 from invchead", "insert into invchead select * from invchead",
        "with c as (select 1) insert into invchead select * from c", "create table x as select * from invchead", "cache table x as select * from invchead", "set a = 1", "explain select 1", "show tables",
        "begin select 1; end", "", "select company, no_such from invchead", "select p.company, p.latest from invchead p join (select company, docinvoiceamt as latest from invchead) d on d.company = p.company",
        "with invoices as (select company as latest from invchead) select invchead.latest from invchead join invoices on true",
    ],
)
def test_what_may_not_run(given, spark, sql):
    with pytest.raises(PlanError):
        guarded(spark, sql, given)


def test_python_functions_of_the_session_are_refused(spark, given):
    spark.udf.register("mine", lambda x: x, "string")
    with pytest.raises(PlanError):
        guarded(spark, "select mine(company) from invchead", given)


@pytest.mark.parametrize(
    "sql",
    [
        "select company, upper(trim(company)) || '-' as x, coalesce(nullif(posted, 0), 1) + 2 * 3 from invchead where company like 'a%' and posted in (0, 1) and invoicenum between 1 and 5",
        "select company, sum(docinvoiceamt) s, count(distinct invoicenum) n, avg(posted), max(invoicedate), count_if(posted = 1), round(sum(docinvoiceamt) / nullif(count(*), 0), 2) from invchead group by company having sum(docinvoiceamt) > 5 order by s desc limit 3",
        "select year(to_date(invoicedate)), date_format(to_date(invoicedate), 'yyyy-MM'), date_add(to_date(invoicedate), 3), datediff(current_date(), to_date(invoicedate)), add_months(to_date(invoicedate), -12), date_trunc('month', to_timestamp(invoicedate)) from invchead",
        "select company, row_number() over (partition by company order by invoicenum) r, sum(docinvoiceamt) over (partition by company) t, lag(docinvoiceamt) over (order by invoicenum) from invchead",
        "with a as (select * from invchead), b as (select company, count(*) n from a group by company) select a.company, n from a join b on a.company = b.company where exists (select 1 from orderhed o where o.company = a.company)",
        "select company, (select max(docextprice) from invcdtl d where d.company = h.company) m from invchead h where invoicenum in (select invoicenum from invcdtl) union all select company, null from orderhed",
        "select case when posted = 1 then 'yes' else 'no' end, if(posted = 1, 1, 0), substring(company, 1, 2), replace(company, 'a', 'b'), length(company), left(company, 1), lpad(company, 3, '0'), split_part(company, 'a', 1), concat_ws('-', company, company), regexp_replace(company, 'a', '') from invchead",
        "select company, posted, sum(docinvoiceamt) from invchead group by rollup (company, posted)", "select * from values (1, 'a') as t(x, y)", "select 1 as x", "-- a note; drop table x\nselect 'drop table; x' as y /* delete */;",
    ],
)
def test_what_may_run(given, spark, sql):
    assert guarded(spark, sql, given).count() >= 0


def test_the_session_stays_as_it_is(spark, given):
    spark.createDataFrame([(7,)], "mine int").createOrReplaceTempView("invchead")
    df = guarded(spark, "select company from invchead", given)
    assert spark.table("invchead").columns == ["mine"]
    spark.catalog.dropTempView("invchead")
    assert df.count() == 3 and df.sparkSession is spark and df.join(given["orderhed"], "company").count() == 2
    assert not spark.catalog.tableExists("invchead")


def test_two_calls_at_once_read_their_own_tables(spark):
    from concurrent.futures import ThreadPoolExecutor

    def run(k):
        return guarded(spark, "select v from t", {"t": spark.createDataFrame([(k,)], "v int")}).first().v

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(run, range(12))) == list(range(12))


def test_lineage(spark, given):
    q = Inspected(spark, "with c as (select company k, docinvoiceamt * 2 v from invchead where posted = 1) select k, sum(v) s, max(opendate) from c join orderhed o on c.k = o.company group by k", given)
    by_name = {a.name(): {(t, c) for _, t, c in q.lineage.columns[a.exprId().id()]} for a in (q.plan.output().apply(i) for i in range(q.plan.output().size()))}
    assert by_name == {"k": {("invchead", "company")}, "s": {("invchead", "docinvoiceamt")}, "max(opendate)": {("orderhed", "opendate")}}
    assert not q.own_columns("k") and {leaf.table for leaf in q.lineage.leaves} == {"invchead", "orderhed"}
    assert ("invchead", "invoicedate") not in q.lineage.used and ("invchead", "posted") in q.lineage.used


@pytest.mark.parametrize("sql", ["select company from invchead where company = 'YourCompany'", "select company from invchead where company in ('a', 'companyid')"])
def test_placeholders_of_tenants(spark, given, sql):
    with pytest.raises(PlanError, match="placeholder"):
        guarded(spark, sql, given, tenant="company")


SCOPE = "'invoicedate' time_scope, 'docinvoiceamt' amount_scope, 'posted = 1' status_scope, 'not said' tax_scope"
METRIC = Reference("metric", "invchead", "docinvoiceamt", "posted", "invoicedate", ("posted = 1",))
HEAD = f"select ih.company, ih.invoicedate, ih.docinvoiceamt, {SCOPE}"


def finance(*references, **how):
    return Finance(references or (METRIC,), details=(("invcdtl", "invoicenum"),), **how)


@pytest.mark.parametrize(
    "sql",
    [
        f"{HEAD} from invchead ih where ih.posted = 1",
        f"{HEAD} from invchead ih where 1 = ih.posted and ih.company = 'a'",
        f"{HEAD} from invchead ih join orderhed o on o.company = ih.company and ih.posted = 1",
        f"with f as (select * from invchead ih where ih.posted = 1), p as (select * from f) {HEAD} from p ih",
        f"{HEAD} from (select ih.* from invchead ih where ih.posted = 1) ih",
        f"with c as (select * from invchead) {HEAD} from c ih join c other on other.company = ih.company where other.posted = 1 and ih.posted = 1",
        f"with orders as (select doc.company from orderhed doc) select doc.company, doc.invoicedate, doc.docinvoiceamt, {SCOPE} from invchead doc where doc.posted = 1",
        f"{HEAD} from invchead ih left join (select invoicenum, sum(docextprice) s from invcdtl group by invoicenum) d on d.invoicenum = ih.invoicenum where ih.posted = 1",
        f"select o.company, o.opendate, ih.docinvoiceamt, {SCOPE} from orderhed o left join invchead ih on o.company = ih.company and ih.posted = 1",
        f"{HEAD} from invchead ih where ih.posted = 1 union all {HEAD} from invchead ih where ih.posted = 1",
        f"select k, company, invoicedate, docinvoiceamt, {SCOPE} from (select posted k, company, invoicedate, docinvoiceamt from invchead) where k = 1",
        f"select company, max(invoicedate), sum(docinvoiceamt), {SCOPE} from invchead group by company, posted having posted = 1",
    ],
)
def test_finance_queries_that_hold(spark, given, sql):
    assert guarded(spark, sql, given, finance=finance()).count() >= 0


@pytest.mark.parametrize(
    ("sql", "what"),
    [
        (f"{HEAD} from invchead ih", "condition"),
        (f"{HEAD}, ih.posted from invchead ih", "condition"),
        (f"{HEAD} from invchead ih where ih.posted = 1 or ih.company = 'a'", "condition"),
        (f"{HEAD} from invchead ih where not (ih.posted = 1)", "condition"),
        (f"{HEAD} from invchead ih where ih.posted = 0", "condition"),
        (f"{HEAD} from invchead ih where ih.posted = ih.posted", "condition"),
        (f"{HEAD} from invchead ih join orderhed invchead on invchead.company = ih.company where invchead.posted = '1'", "condition"),
        (f"{HEAD} from invchead ih join invchead other on other.company = ih.company where other.posted = 1", "condition"),
        (f"with no as (select * from invchead where posted = 1) {HEAD} from invchead ih", "condition"),
        (f"with c as (select * from invchead) {HEAD} from c ih join c other on other.company = ih.company where other.posted = 1", "condition"),
        (f"{HEAD} from invchead ih left join orderhed o on ih.posted = 1 and o.company = ih.company", "condition"),
        (f"{HEAD} from invchead ih where ih.posted = 1 union all {HEAD} from invchead ih", "condition"),
        (f"select o.company, o.opendate, (select sum(docinvoiceamt) from invchead) v, {SCOPE} from orderhed o", "condition"),
        (f"select company, max(invoicedate), sum(docinvoiceamt), {SCOPE} from invchead group by company having max(posted) = 1", "condition"),
        (f"{HEAD} from invchead ih join invcdtl d on d.invoicenum = ih.invoicenum where ih.posted = 1", "summed"),
        (f"{HEAD} from invchead ih join (select company, sum(docextprice) s from invcdtl group by company) d on d.company = ih.company where ih.posted = 1", "summed"),
        ("select company, invoicedate, docinvoiceamt from invchead where posted = 1", "explains"),
        (f"select o.company, o.opendate, {SCOPE} from orderhed o", "invchead"),
    ],
)
def test_finance_queries_that_do_not(spark, given, sql, what):
    with pytest.raises(PlanError, match=what):
        guarded(spark, sql, given, finance=finance())


@pytest.mark.parametrize(
    ("reference", "estimate", "what"),
    [
        (None, False, "metric or template"), (Reference("dataset"), False, "metric or template"), (None, True, "reference"),
        (Reference("metric", "invchead", "", "posted", "invoicedate", ("posted = 1",)), False, "declare its amount"),
        (Reference("metric", "invchead", "docinvoiceamt", "", "invoicedate", ("posted = 1",)), False, "declare its status field"),
        (Reference("metric", "invchead", "docinvoiceamt", "posted", "invoicedate", ()), False, "condition on its status"),
        (Reference("metric", "invchead", "docinvoiceamt", "posted", "invoicedate", ("company = 'a'",)), False, "on its status field"),
    ],
)
def test_references(spark, given, reference, estimate, what):
    rules = Finance((reference,) if reference else (), estimate, details=())
    with pytest.raises(PlanError, match=what):
        guarded(spark, f"{HEAD} from invchead ih where ih.posted = 1 and ih.company = 'a'", given, finance=rules)


def test_templates_and_estimates(spark, given):
    sql = f"{HEAD} from invchead ih where ih.posted = 1"
    assert guarded(spark, sql, given, finance=Finance((Reference("template"),))).count() == 2
    assert guarded(spark, sql, given, finance=Finance((Reference("family"),), estimate=True)).count() == 2
    with pytest.raises(PlanError, match="filter a status"):
        guarded(spark, f"{HEAD}, ih.posted from invchead ih", given, finance=Finance((Reference("template"),)))
    with pytest.raises(PlanError, match="field of date"):
        guarded(spark, f"select company, docinvoiceamt, {SCOPE} from invchead where posted = 1", given, finance=Finance((Reference("template"),)))
