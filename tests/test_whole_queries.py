"""Queries without bounds on ids, where no SQL checks them, against brute force."""

from __future__ import annotations

import math
from itertools import combinations

import __spark_entry__ as entry
import pytest
from weftline.plans import rules
from weftline.plans.rollups import made


def metres(a, b):
    p, q = math.radians(a.lat), math.radians(b.lat)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b.lon - a.lon) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def test_entity_groups_are_transitive(spark, tmp_path):
    spark.range(200).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    places = made(spark, str(tmp_path), "customer", rules.PLACES).collect()
    root = {p.id: p.id for p in places}
    direct = set()
    for a, b in combinations(places, 2):
        if a.name == b.name and a.source != b.source and (a.lat is None or b.lat is None or metres(a, b) < 1000):
            direct.add((a.id, b.id))
            x, y = root[a.id], root[b.id]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert (4, 7) not in direct and root[4] == root[7]
    got = entry.queries()["gr_03_entity_groups"](spark, str(tmp_path))
    assert {r.node: r.root for r in got.collect()} == root


@pytest.mark.parametrize("name", ["ag_18_published_areas_all", "jn_15_last_before_all", "jn_05_month"])
def test_whole_queries_are_there_with_sql(name):
    assert name in entry.queries() and name in entry.oracle_sql()
