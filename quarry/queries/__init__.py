"""The registered queries and their SQL oracles, gathered from the modules of this package."""

from __future__ import annotations

from quarry.queries import audits, documents, metrics, records, relational, retrieval, rules

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "metric_order_amount_by_category_month"
for _module in (metrics, relational, documents, records, retrieval, rules, audits):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
