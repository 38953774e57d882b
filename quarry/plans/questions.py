"""Time ranges and plans from plain words, by fixed rules; no model is asked."""

from __future__ import annotations

import re
from datetime import date

from quarry.plans.model import AnalysisPlan, PlanError, TimeRange
from quarry.plans.phrases import comparison, time_range

#: Recipes: a pattern that the question has to hold, and the plan that it stands for; the first that fits.
RECIPES: tuple[tuple[str, dict], ...] = (
    (r"\bgrowth\b|增长|增幅", {"metrics": ("order_total",), "dimensions": ("segment",), "comparison": "year", "time": TimeRange("current_year")}),
    (r"\boverdue\b|逾期|延期", {"metrics": ("overdue_amount",), "dimensions": ("priority",)}),
    (r"\bdelays?\b|延误|拖延", {"metrics": ("delay_days_max",), "dimensions": ("supplier",)}),
    (r"\bdiscounts?\b|折扣", {"metrics": ("discount_rate",), "dimensions": ("brand",)}),
    (r"\bshipped\b|发货", {"metrics": ("shipped_amount",), "dimensions": ("category",)}),
    (r"\bcustomers\b|客户数", {"metrics": ("customer_count",), "dimensions": ("segment",)}),
    (r"\borders\b|订单", {"metrics": ("order_count", "order_total"), "dimensions": ("priority",)}),
    (r"\bquantity\b|数量", {"metrics": ("order_quantity",), "dimensions": ("category",)}),
    (r"\bsales\b|销售", {"metrics": ("order_amount",), "dimensions": ("category",)}),
)
#: Dimensions that a question can ask for by `by`, `per` or 按.
BY = (("supplier", "supplier|供应商"), ("brand", "brand|品牌"), ("segment", "segment|行业"), ("priority", "priority|优先级"), ("tenant", "region|地区|区域"), ("category", "category|类别|品类"), ("status", "status|状态"))


def plan_for(text: str, as_of: date) -> AnalysisPlan:
    """The plan of the first recipe that fits, with the time, comparison, dimension, period and limit that the question names; a question without a recipe is refused."""
    low = text.lower()
    for pattern, parts in RECIPES:
        if not re.search(pattern, low):
            continue
        plan = dict(parts)
        if time := time_range(text, as_of):
            plan["time"] = time
        if compared := comparison(text):
            plan |= {"comparison": compared, "time": plan.get("time") or TimeRange("current_month" if compared == "month" else "current_year")}
        asked = [d for d, names in BY if re.search(rf"(?:\bby|\bper|\beach|按|各)\s*(?:{names})", low)]
        if asked:
            plan["dimensions"] = tuple(asked)
        if m := re.search(r"\btop\s*(\d+)|前\s*(\d+)", low):
            plan |= {"limit": int(m[1] or m[2]), "order_by": plan["metrics"][0]}
        if re.search(r"by month|monthly|per month|按月|逐月|每月", low) and "comparison" not in plan:
            plan["period"] = "month"
        return AnalysisPlan(**plan)
    raise PlanError("no rule knows this question")
