"""The queries of the library and the SQL that checks them."""

from __future__ import annotations

from weftline.plans import choices, crawling, curation, curves, editing, landed, rollups, rules, sourcing
from weftline.plans.common import Query

FLAGSHIP = "fn_05_day_score"
_ALL = [curves.PLANS, rollups.PLANS, choices.PLANS, rules.PLANS, curation.PLANS, landed.PLANS, crawling.PLANS, editing.PLANS, sourcing.PLANS]


def queries() -> dict[str, Query]:
    return {name: query for plans in _ALL for name, query in plans.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plans in _ALL for name, sql in plans.sql.items()}
