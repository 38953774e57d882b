"""Phrases of time, each through the compiler."""

from datetime import date

import pytest

from quarry.plans import phrases, questions
from quarry.plans.catalog import AS_OF, CATALOG
from quarry.plans.compiler import compile_plan
from quarry.plans.model import AnalysisPlan, PlanError, TimeRange
from quarry.plans.windows import bounds
from quarry.sources.tables import table

T = TimeRange
RANGES = [
    ("上个月的订单", T("previous_month")), ("上月销售", T("previous_month")), ("previous month", T("previous_month")), ("last month's sales", T("previous_month")),
    ("本月", T("current_month")), ("这个月", T("current_month")), ("当月", T("current_month")), ("this month", T("current_month")), ("6月份订单", T("month", "2001-06")), ("十二月", T("month", "2001-12")),
    ("in June", T("month", "2001-06")), ("2000-12", T("month", "2000-12")), ("2000年3月", T("month", "2000-03")), ("今年", T("current_year")), ("this year", T("current_year")), ("今年和去年", T("current_year")), ("同比", T("current_year")),
    ("今年以来", T("year_to_date")), ("year to date", T("year_to_date")), ("上半年", T("first_half")), ("first half", T("first_half")),
    ("最近3个月", T("days", count=90)), ("近三个月", T("days", count=90)), ("last 3 months", T("days", count=90)), ("最近一个季度", T("days", count=90)), ("近一季度", T("days", count=90)), ("past quarter", T("days", count=90)),
    ("最近一个月", T("days", count=30)), ("近1个月", T("days", count=30)), ("近 1 个月", T("days", count=30)), ("最近半年", T("days", count=180)), ("近6个月", T("days", count=180)), ("逐月", T("days", count=180)), ("销售趋势", T("days", count=180)),
    ("持续下降", T("days", count=180)), ("近15天", T("days", count=15)), ("past ten days", T("days", count=10)), ("last two weeks", T("days", count=14)), ("过去二十一天", T("days", count=21)), ("last 3 complete months", T("complete_months", count=3)),
    ("最近3个完整月", T("complete_months", count=3)), ("last 2 years", T("days", count=730)), ("nothing of the kind", None), ("13月", None), ("", None), ("近0天", None),
]


@pytest.mark.parametrize(("text", "want"), RANGES)
def test_ranges(text, want):
    assert phrases.time_range(text, AS_OF) == want


@pytest.mark.parametrize(("text", "want"), [("同比增长", "year"), ("较去年", "year"), ("与去年同期", "year"), ("今年对去年", "year"), ("versus last year", "year"), ("YoY", "year"), ("环比", "month"), ("与上月相比", "month"), ("than the previous month", "month"), ("今年", None), ("上月", None)])
def test_comparisons(text, want):
    assert phrases.comparison(text) == want


def test_grain_and_windows():
    assert phrases.grain(T("previous_month"), None) == phrases.grain(None, "month") == "month" and phrases.grain(T("current_year"), "year") == "year" and phrases.grain(T("days", count=5), None) is None
    assert bounds(T("days", count=90), date(2001, 8, 1)) == (date(2001, 5, 4), date(2001, 8, 2))
    assert [phrases.number(w) for w in ("12", "twelve", "十", "十二", "二十", "三十五", "七")] == [12, 12, 10, 12, 20, 35, 7]


@pytest.mark.parametrize("text", sorted({t for t, w in RANGES if w}))
def test_each_range_compiles(spark, sf_dir, text):
    plan = AnalysisPlan(metrics=("order_total",), dimensions=("segment",), time=phrases.time_range(text, AS_OF))
    df = compile_plan(lambda n: table(spark, sf_dir, n), CATALOG, plan, AS_OF)
    low, high = bounds(plan.time, AS_OF)
    text_ = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.columns == ["segment", "order_total"] and str(low) in text_ and str(high) in text_


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("top 5 sales by month in the last 3 complete months", {"metrics": ("order_amount",), "limit": 5, "period": "month", "time": T("complete_months", count=3)}),
        ("按供应商的销售排行 前10", {"metrics": ("order_amount",), "dimensions": ("supplier",), "limit": 10}), ("上月各地区订单", {"dimensions": ("tenant",), "time": T("previous_month")}),
        ("订单环比", {"comparison": "month", "time": T("current_month")}), ("销售同比", {"comparison": "year", "time": T("current_year")}), ("逾期", {"metrics": ("overdue_amount",)}), ("增长", {"comparison": "year"}),
        ("discounts per brand this year", {"metrics": ("discount_rate",), "dimensions": ("brand",), "time": T("current_year")}), ("shipped by category in 2000-12", {"metrics": ("shipped_amount",)}),
    ],
)
def test_questions_compile(spark, sf_dir, text, want):
    plan = questions.plan_for(text, AS_OF)
    assert {k: getattr(plan, k) for k in want} == want
    compile_plan(lambda n: table(spark, sf_dir, n), CATALOG, plan, AS_OF).schema  # noqa: B018


def test_other_questions_are_refused():
    with pytest.raises(PlanError):
        questions.plan_for("今天天气", AS_OF)
