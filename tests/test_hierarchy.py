"""Deep chains, cycles and missing parents against plain loops; numbers in many tasks."""

from __future__ import annotations

import random

from weftline.operators import graph, hierarchy
from weftline.operators.lineage import numbered

SCHEMA = "id long, parent_id long, name string, rock string"


def chain_of(parents, i):
    """(ids up from i, whether a root ends them)."""
    seen = []
    while i is not None and i not in seen:
        seen.append(i)
        if i not in parents:
            return seen, False
        i = parents[i]
    return seen, i is None


def forest():
    r = random.Random(1)
    rows = [(0, None, "root", "granite")] + [(i, i - 1, f"a{i}", None if i % 7 else f"rock {i}") for i in range(1, 41)]  # one chain of 41
    rows += [(i, r.choice([None, *range(max(100, i - 9), i)]) if i > 100 else None, f"b{i}", r.choice([None, "lime"])) for i in range(100, 160)]
    rows += [(200, 201, "c", None), (201, 202, "c", "chalk"), (202, 200, "c", None), (203, 200, "under", None), (300, 999, "lost", None), (301, 300, "lost", "slate")]
    return rows


def test_resolve_follows_any_depth_and_leaves_out_cycles(spark):
    rows = forest()
    parents, names, rocks = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}, {r[0]: r[3] for r in rows}
    want = {}
    for i in parents:
        up, proper = chain_of(parents, i)
        if proper:
            want[i] = ([names[j] for j in up[::-1]], len(up) - 1, next((rocks[j] for j in up if rocks[j]), None))
    areas = spark.createDataFrame(rows, SCHEMA)
    got = {x.id: (x.path_tokens, x.depth, x.eff_rock) for x in hierarchy.resolve(areas, ["rock"]).collect()}
    assert got == want and max(d for _, d, _ in got.values()) == 40
    detached = {x.id for x in hierarchy.resolve(areas, ["rock"], keep_detached=True).collect()}
    assert detached == set(parents)
    assert hierarchy.resolve(areas.limit(0), ["rock"]).count() == 0


def test_ancestors_of_chains_and_cycles(spark):
    rows = forest()
    parents = {r[0]: r[1] for r in rows}
    want = {(i, a, k) for i in parents for k, a in enumerate(chain_of(parents, i)[0])}
    got = [tuple(x) for x in hierarchy.ancestors(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_numbers_are_unique_and_in_order(spark):
    rows = spark.range(0, 5000, numPartitions=7).selectExpr("(id * 7919) % 5003 AS k")
    got = sorted((x.k, x.n) for x in numbered(rows, "k", "n").collect())
    assert [n for _, n in got] == list(range(1, 5001))
    assert numbered(rows.limit(0), "k", "n").count() == 0


def test_connected_components_take_the_smallest_id(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)]
    root = {n: n for e in edges for n in e}
    for a, b in edges:
        x, y = root[a], root[b]
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert {x.node: x.root for x in graph.connected(spark.createDataFrame(edges, "a long, b long")).collect()} == root
