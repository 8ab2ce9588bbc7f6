"""Adapters, walks, leases, hand-over, geodesics, validation, relocation and nested documents on small cases."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import geo, markup
from weftline.operators import crawl, dashboard, hierarchy, lineage, walk
from weftline.sources import adapters, versions
from weftline.streaming import leases, queues

# --- markup and adapters


def test_bracketed_minds_strings_and_truncation():
    page = """<p>[1]</p>table_data = [{"a": "x ] \\" [", "b": [1, [2]]}, "it's"]; more = ["""
    assert json.loads(markup.bracketed(page, "table_data = ")) == [{"a": 'x ] " [', "b": [1, [2]]}, "it's"]
    for cut in range(page.index("= [") + 2, page.index("; more")):
        assert markup.bracketed(page[:cut], "table_data = ") is None
    assert markup.bracketed(None, "x") is None and markup.bracketed("table_data = {}", "table_data = ") is None
    assert markup.bracketed("table_data = [nope]", "table_data = ") is None
    assert markup.bracketed("v = [" + "[" * 50_000 + "]" * 50_001, "v = ") is None  # nested too deep to be read


def test_rows_stand_under_the_last_heading():
    page = "<table><tr><td>a</td></tr></table><h2>One <i>x</i></h2><table><tr><th>h<tr><td>b<br>c</td><td><a href=/l>d</a></td></tr></table><h3>Two</h3><tr><td>e"
    got = [(r["heading"], r["level"], r["cells"], r["href"]) for r in markup.heading_rows(page)]
    assert (None, 0, ["a"], None) in got and ("One x", 2, ["b c", "d"], "/l") in got
    assert markup.heading_rows(None) == [] and markup.heading_rows("<h1>") == []


def test_bold_entries_leave_scripts_out():
    page = "intro <script>no</script>text<b>One*</b> E1 5b, 20m<b></b>x<b>Two"
    assert markup.bold_entries(page) == [{"name": None, "text": "intro text"}, {"name": "One*", "text": "E1 5b, 20m"}, {"name": "", "text": "x"}, {"name": "Two", "text": ""}]


def test_every_adapter_reads_any_page(spark):
    pages = ["", "<", "<div class=route data-route-tick='{}'>", "bbox: [[91, 2], [3, 4]]", '<meta property="place:location:latitude" content="95">', "<b>A</b> E1", None, "<td><tr><a href=/vie/1/>"]
    rows = spark.createDataFrame([("k", str(i), f"u{i}", "n", p) for i, p in enumerate(pages)], adapters.LANDED)
    for source in adapters.REGISTRY:
        got = {r["item"]: r for r in adapters.parsed(rows, source).collect()}
        assert len(got) == len(pages)
    tree = {r["item"]: r["rejected"] for r in adapters.parsed(rows, "area_tree").collect()}
    assert tree["u2"].startswith("KeyError") and tree["u4"] == "lat out of range" and tree["u0"] is None
    assert adapters.parsed(rows.limit(0), "area_tree").count() == 0


def test_source_reads_every_line_once_whatever_the_ranges(spark, tmp_path, monkeypatch):
    lines = [json.dumps({"kind": "crag", "id": str(i), "url": f"u{i}", "name": f"N{i}", "payload": "<p>" + "é" * (i * 7 % 90)}, ensure_ascii=i % 2 == 0) for i in range(60)]
    lines[7], lines[30] = "{broken", "[1]"
    (tmp_path / "a.json").write_text("\n".join(lines[:40]) + "\n")
    (tmp_path / "b.json").write_text("\n".join(lines[40:]))
    (tmp_path / "_SUCCESS").write_text("x")
    spark.dataSource.register(adapters.LandedSource)
    for size in (1, 17, 100, 1 << 20):
        reader = adapters._Reader(_schema(), {"path": str(tmp_path), "source": "route_register"})
        monkeypatch.setattr(adapters._Reader, "RANGE", size)
        found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert len(found) == 60 and sum(r["rejected"] is not None for r in found) == 2
        assert sorted(r["name"] for r in found if r["name"]) == sorted(f"N{i}" for i in range(60) if i not in (7, 30))
    read = spark.read.format("landed_source").option("source", "route_register").load(str(tmp_path))
    assert read.count() == 60 and read.where("rejected LIKE 'not JSON%'").count() == 2
    with pytest.raises(Exception, match="source: one of"):
        spark.read.format("landed_source").option("source", "nope").load(str(tmp_path)).count()


def _schema():
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(adapters.SCHEMA)


# --- walk

PAGE = "url string, south double, west double, north double, east double, lat double, lon double, n_routes int, next array<string>"


def test_walk_prunes_keeps_and_ends(spark):
    here, far = (0.0, 0.0, 10.0, 10.0), (50.0, 50.0, 60.0, 60.0)
    none = (None,) * 4
    pages = [
        ("root", *none, None, None, 0, ["a", "b", "gone", "a"]), ("a", *here, None, None, 0, ["c", "d", "e", "root"]), ("b", *far, None, None, 0, ["x"]),
        ("c", *none, 5.0, 5.0, 2, []), ("d", *none, 55.0, 5.0, 2, ["y"]), ("e", *none, None, None, 1, None), ("x", *none, 5.0, 5.0, 1, []), ("y", *none, 5.0, 5.0, 1, []),
    ]
    pages += [(f"l{i}", *none, None, None, 0, [f"l{i + 1}"]) for i in range(40)] + [("l40", *none, 1.0, None, 1, None)]  # deep; a point with one coordinate isn't kept
    got = {r.url: (r.depth, r.kept) for r in walk.pruned_walk(spark.createDataFrame(pages, PAGE), spark.createDataFrame([("root",), ("l0",), ("nowhere",)], "url string"), (0.0, 0.0, 20.0, 20.0)).collect()}
    assert got["c"] == (2, True) and got["d"] == (2, False) and got["e"] == (2, True) and got["b"] == (1, False) and got["l40"] == (40, False)
    assert "x" not in got and "y" not in got and "gone" not in got and "nowhere" not in got
    assert walk.pruned_walk(spark.createDataFrame([], PAGE), spark.createDataFrame([("root",)], "url string"), (0.0, 0.0, 1.0, 1.0)).count() == 0


# --- leases and hand-over


def brute_status(rows, now):
    attempts = sum(w == "claim" for _, w in rows)
    claimed = max((t for t, w in rows if w == "claim"), default=None)
    failed = max((t for t, w in rows if w == "error"), default=None)
    if any(w == "done" for _, w in rows):
        return attempts, "done"
    if claimed is not None and claimed + 30 > now and (failed is None or failed < claimed):
        return attempts, "claimed"
    return attempts, "failed" if attempts >= 3 else "pending"


def test_leases_over_batches_restarts_and_disorder(spark, tmp_path):
    r = random.Random(3)
    log = [(i % 23, r.randrange(300), r.choice(["claim", "claim", "error", "seen", "seen", "done" if i % 23 < 3 else "seen"])) for i in range(400)]
    stamp = lambda m: f"2026-01-01T{m // 60:02d}:{m % 60:02d}:00.000Z"
    landed, target, checkpoint = (str(tmp_path / x) for x in ("log", "out", "check"))
    with leases.state_store(spark):
        for part in range(4):  # by time, as the watermark allows; in any order within a part
            some = [x for x in log if part * 75 <= x[1] < (part + 1) * 75]
            spark.createDataFrame([(i, stamp(m), w) for i, m, w in some], "id long, ts string, what string").write.mode("append").json(landed)
            stream = spark.readStream.schema("id long, ts timestamp, what string").json(landed)
            leases.lease_changes(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    now = max(m for _, m, _ in log)
    changes = spark.read.schema(leases.CHANGES).parquet(target)
    got = {x.id: (x.attempts, x.status) for x in leases.last_changes(changes).collect()}
    want = {k: brute_status([(m, w) for i, m, w in log if i == k], now) for k in {i for i, _, _ in log}}
    assert got == want
    assert {x.id for x in leases.dead_letters(changes).collect()} == {k for k, v in want.items() if v[1] == "failed"}
    assert spark.conf.get(leases.STORE[0], None) != leases.STORE[1]


def test_an_id_is_handled_once_over_batches_and_a_cut_off_batch_repeats(spark, tmp_path):
    landed, target, checkpoint = (str(tmp_path / x) for x in ("items", "out", "check"))
    calls, failing = [], {"on": False}

    def handle(batch):
        calls.append(batch.count())
        if failing["on"]:
            raise RuntimeError("lost")
        return batch.withColumn("seen", F.lit(1))

    def land(rows):
        spark.createDataFrame(rows, "id long, v string").write.mode("append").json(landed)
        queues.follow_queue(spark, landed, "id bigint, v string", target, checkpoint, handle).awaitTermination()

    land([(1, "b"), (2, "x"), (1, "a"), (None, "n")])
    failing["on"] = True
    with pytest.raises(Exception):
        land([(1, "z"), (3, "c")])
    failing["on"] = False
    land([(2, "again"), (4, "d")])
    got = sorted(((x.id, x.v) for x in spark.read.parquet(target).collect()), key=str)
    assert got == sorted([(1, "a"), (2, "x"), (3, "c"), (4, "d"), (None, "n")], key=str)


# --- geodesics


@pytest.mark.parametrize(
    "a,b,metres",
    [
        ((40.6, -73.8), (51.6, -0.5), 5551759.400), ((0, 0), (0.5, 179.5), 19936288.579), ((0, 0), (0.5, 179.7), 19944127.421), ((-30, 0), (29.9, 179.8), 19989832.827),
        ((0, 0), (0, 180), 20003931.459), ((90, 0), (-90, 0), 20003931.459), ((30, 0), (-30, 180), 20003931.459), ((0, 0), (0, 1), 111319.491), ((0, 0), (0, 179), 19926188.852),
        ((10, 20), (10, 380), 0.0), ((0, 179.9), (0, -179.9), 22263.898),
    ],
)
def test_geodesics_against_published_values(spark, a, b, metres):
    rows = spark.createDataFrame([(*map(float, a), *map(float, b))], "a double, b double, c double, d double")
    got = rows.select(geo.geodesic("a", "b", "c", "d"), geo.geodesic("c", "d", "a", "b")).first()
    assert got[0] == pytest.approx(metres, abs=0.5) and got[1] == pytest.approx(metres, abs=0.5)


def test_geodesics_without_coordinates_and_the_radius_search(spark):
    r = random.Random(1)
    points = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(3000)] + [(9000, None, 1.0), (9001, 91.0, 0.0), (9002, 1.0, None)]
    rows = spark.createDataFrame(points, "id long, lat double, lon double")
    all_ = {x.id: x.m for x in rows.select("id", geo.geodesic("lat", "lon", F.lit(80.0), F.lit(175.0)).alias("m")).collect()}
    assert all_[9000] is None and all_[9001] is None and all_[9002] is None
    got = {x.id for x in geo.within_spheroid(rows, 80.0, 175.0, 1500).collect()}
    assert got == {i for i, m in all_.items() if m is not None and m <= 1_500_000} and len(got) > 10


# --- hierarchies and numbers


def test_folds_and_marks_on_deep_trees_and_circles(spark):
    rows = [(i, i - 1 if i else None, "v" if i % 50 == 0 else None, f"n{i}") for i in range(300)] + [(1000, 1001, None, "c"), (1001, 1000, "w", "c"), (1002, 1000, None, "c"), (2000, 2999, None, "m")]
    areas = spark.createDataFrame(rows, "id long, parent_id long, rock string, name string")
    got = {x.id: (x.rock, x.approx) for x in hierarchy.nearest_with(areas, ["rock"]).collect()}
    assert got[149] == ("v", True) and got[100] == ("v", False) and got[1002] == ("w", True) and got[1000] == ("w", True) and 2000 not in got
    live = spark.createDataFrame([(120, "publish"), (250, "draft"), (1002, "publish"), (2000, "publish"), (5555, "publish")], "area_id long, status string")
    assert {x.id for x in hierarchy.published_areas(areas, live).collect()} == {*range(121), 1000, 1001, 1002, 2000, 2999}


def test_numbers_within_hot_keys(spark):
    r = random.Random(2)
    rows = [(None if k == 9 else k, r.randrange(10**6), i) for i in range(4000) for k in [r.choice([1] * 8 + [2, 9])]]
    df = spark.createDataFrame(rows, "k int, v int, i int").repartition(7)
    got = {x.i: x.n for x in lineage.numbered_within(df, ["k"], [F.col("v").desc(), F.col("i").asc()], "n").collect()}
    for k in {x[0] for x in rows}:
        want = sorted((x for x in rows if x[0] == k), key=lambda x: (-x[1], x[2]))
        assert [got[x[2]] for x in want] == list(range(1, len(want) + 1))
    assert sorted(x.n for x in lineage.numbered_within(df, [], [F.col("i")], "n").collect()) == list(range(1, 4001))
    assert lineage.numbered_within(df.limit(0), ["k"], [F.col("i")], "n").count() == 0


# --- validation, seeds, topos


def test_schema_messages(spark):
    schema = crawl.RecordSchema(
        rules=(crawl.Rule("name", required=True, not_blank=True), crawl.Rule("tags", one_of=("a", "b"), items=True), crawl.Rule("n", least=1, most=3, when="name = 'x'"), crawl.Rule("up", refers="area")),
        evidence=(("hazards", "code", "span", "critical"),),
        vocabularies={"critical": ("rockfall",)},
    )
    kind = "id int, name string, tags array<string>, n int, up int, hazards array<struct<code: string, span: string>>"
    rows = [(1, "x", ["a"], 2, 5, []), (2, None, None, 9, None, None), (3, " ", ["c", None], 0, 6, [("rockfall", " "), ("rockfall", None), ("other", None)]), (4, "x", [], 9, 5, [("rockfall", "seen")])]
    got = sorted(map(tuple, crawl.invalid_records(spark.createDataFrame(rows, kind), "id", schema, {"area": spark.createDataFrame([(5,)], "id int")}).collect()))
    assert got == [(2, "name: is missing"), (3, "hazards: no evidence for rockfall"), (3, "name: is blank"), (3, "tags: unknown c, nothing"), (3, "up: no area 6"), (4, "n: is over 3")]


def test_seeding_twice_adds_nothing(spark):
    frontier = spark.createDataFrame([("o", "a", "p"), ("other", "b", "p")], "source string, external_id string, path string")
    found = spark.createDataFrame([("a", "new"), ("b", "z"), ("b", "y")], "uuid string, path string")
    once = crawl.seed(frontier, found, "o")
    want = [("o", "a", "p"), ("o", "b", "y"), ("other", "b", "p")]
    assert sorted(map(tuple, once.collect())) == want and sorted(map(tuple, crawl.seed(once, found, "o").collect())) == want


# --- relocation and documents


def test_a_failure_between_the_phases_leaves_the_old_tree(spark, tmp_path):
    root = str(tmp_path / "tree")
    kind = "id long, sector string, file string, country string, region string, crag string"
    areas = spark.createDataFrame([(1, None, "country", "Éire"), (2, 1, "region", "Down"), (3, 2, "crag", "Head"), (4, 3, "sector", "Left")], "id long, parent_id long, kind string, name string")
    routes = spark.createDataFrame([(7, "A b", None, 4), (8, "a B", " ", 4), (9, "A b", "own", 3), (10, "!", None, None)], "id long, name string, sector string, area_id long")
    assert versions.read_tree(spark, root, kind).count() == 0
    assert versions.relocate(spark, routes.where("id < 9"), areas, root) == 1
    read = lambda: sorted(((x.id, f"{x.country}/{x.region}/{x.crag}/{x.file}", x.sector) for x in versions.read_tree(spark, root, kind).collect()))
    old = [(7, "eire/down/head/a-b.json", "Left"), (8, "eire/down/head/a-b-8.json", "Left")]
    assert read() == old
    versions.prepare(versions.canonical(routes.where("id = 9"), areas), root, ["country", "region", "crag"])  # and then it fails
    assert read() == old
    version = versions.prepare(versions.canonical(routes, areas), root, ["country", "region", "crag"], heavy=1)
    assert version == 2 and read() == old
    versions.publish(spark, root, version)
    versions.publish(spark, root, version)
    assert [x[:1] + x[2:] for x in read()] == [(7, "Left"), (8, "Left"), (9, "own"), (10, None)]
    spark.createDataFrame([(3, 1)], "version int, rows long").coalesce(1).write.json(f"{root}/manifests/3")
    spark.createDataFrame([("x",), ("y",)], "value string").write.text(f"{root}/v=3")
    with pytest.raises(ValueError, match="not those of its manifest"):
        versions.publish(spark, root, 3)


def test_documents_page_hot_parents_and_drop_nothing(spark):
    parents = spark.createDataFrame([(1, "hot"), (2, "none"), (3, "one")], "venue long, name string")
    days = [(1, i % 7 - 3, f"d{i}") for i in range(45)] + [(3, None, "d"), (99, 1, "lost")]
    notes = [(1, "b", i) for i in range(3)] + [(3, "a", None)]
    out = dashboard.nested_documents(parents, "venue", {"days": (spark.createDataFrame(days, "venue long, n long, what string"), ["n"]), "notes": (spark.createDataFrame(notes, "venue long, t string, x long"), ["t", "x"])}, bound=10)
    rows = {(x.venue, x.page): x for x in out.collect()}
    assert sorted(rows) == [(1, p) for p in range(1, 6)] + [(2, 1), (3, 1)] and all(x.pages == (5 if v == 1 else 1) for (v, _), x in rows.items())
    hot = [d for p in range(1, 6) for d in rows[1, p].days]
    assert [len(rows[1, p].days) for p in range(1, 6)] == [10, 10, 10, 10, 5] and [d.n for d in hot] == sorted(d.n for d in hot) and {d.what for d in hot} == {f"d{i}" for i in range(45)}
    assert rows[2, 1].days == [] and rows[3, 1].days[0].n is None and rows[3, 1].notes[0].x is None and [x.x for x in rows[1, 1].notes] == [0, 1, 2]
