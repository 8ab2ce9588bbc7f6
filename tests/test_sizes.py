"""What grows with the input stays spread over tasks and is done once."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftline.operators import hierarchy
from weftline.streaming.leases import LeaseProcessor

TABLES = Path("/root/testdata/sf0.001")
tables = pytest.mark.skipif(not TABLES.exists(), reason="the driver's tables aren't here")


@tables
def test_a_payload_is_parsed_once(spark):
    plan = entry.queries()["src_17_graph_routes"](spark, str(TABLES))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


@tables
def test_register_pages_are_many_tasks_work(spark):
    assert entry.queries()["src_22_route_register"](spark, str(TABLES)).rdd.getNumPartitions() >= 4


class _State:
    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Timers(list):
    def registerTimer(self, at):
        self.append(at)

    def deleteTimer(self, at):
        self.remove(at)


def test_leases_go_by_rows():
    lease = LeaseProcessor()
    lease.state, lease.handle = _State(), _Timers()
    rows = [Row(what=w, micros=m) for w, m in (("claim", 5_000), ("seen", None), ("claim", 9_000), ("error", 1_000))]
    (told,) = lease.handleInputRows((7,), iter(rows), None)
    assert (told.id, told.seq, told.attempts, told.status, told.dead) == (7, 1, 2, "claimed", False)
    assert lease.handle == [30 * 60_000 + 9]
    (told,) = lease.handleInputRows((7,), iter([Row(what="done", micros=10_000)]), None)
    assert (told.seq, told.attempts, told.status) == (2, 2, "done") and lease.handle == [30 * 60_000 + 9]


def test_a_tree_does_not_go_through_the_driver(spark, monkeypatch):
    plans, own = [], hierarchy.Rounds.put

    def put(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return own(self, df, name)

    monkeypatch.setattr(hierarchy.Rounds, "put", put)
    areas = spark.range(1, 9).selectExpr("id", "IF(id = 1, NULL, id - 1) AS parent_id")
    found = hierarchy.fold_up(areas, {"n": F.lit(1)}, {"n": lambda a, b, _: a + b})
    assert {(r.id, r.n) for r in found.collect()} == {(i, i) for i in range(1, 9)}
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)
