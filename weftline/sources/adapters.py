"""Adapters of route sources as a Python data source over landed pages.

An adapter says how a work item's landed page becomes places with routes and further items. Fetching isn't part of it: pages
land as JSON lines (kind, id, url, name, payload) in a folder, once, so that a mistake in a mapping costs no second fetch.

    spark.dataSource.register(LandedSource)
    spark.read.format("landed_source").option("source", "area_tree").load(folder)

Every file is a partition's work, large ones by ranges of lines. A page that an adapter can't read, or that gives a place off
the schema, comes as a row with ``rejected`` set and no place, so nothing is lost in silence. The folder must be one that
pyarrow reaches (a local or shared folder, HDFS, S3); for others read it with Spark and use ``parsed``.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from weftline.functions import markup

Box = tuple[float, float, float, float]  # south, west, north, east

ITEM = "kind string, id string, url string, name string"
LANDED = f"{ITEM}, payload string"
ROUTE = "source_id: string, name: string, grade: string, grade_system: string, length_m: int, pitches: int, stars: int, disciplines: array<string>, url: string, description: string"
SCHEMA = (
    "source string, item string, name string, lat double, lon double, url string, description string, rock string, "
    f"south double, west double, north double, east double, routes array<struct<{ROUTE}>>, next array<struct<url: string, name: string>>, rejected string"
)
_NAMES = "source item name lat lon url description rock south west north east routes next rejected".split()
#: Labels of styles and the disciplines that they stand for. Fixed values.
STYLES = {
    "trad": "trad", "sport": "sport", "boulder": "bouldering", "aid": "aid", "alpine": "alpine", "ice": "ice", "mixed": "mixed",
    "topRope": "tr", "toprope": "tr", "dws": "deepwatersolo",
}
#: Rocks as one source names them. Fixed values.
STONES = {
    "arenaria": "sandstone", "calcare": "limestone", "granito": "granite", "basalto": "basalt", "gneiss": "gneiss", "conglomerato": "conglomerate",
    "dolomia": "dolomite", "quarzite": "quartzite", "scisto": "schist", "ardesia": "slate", "porfido": "volcanic", "calcare dolomitico": "dolomite",
}
_NUMBER = r"(-?[\d.]+)"
_BOX = re.compile(rf"bbox:\s*\[\s*\[\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\]\s*,\s*\[\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\]\s*\]")
_POINT = re.compile(rf'place:location:(latitude|longitude)"\s+content="{_NUMBER}"')
#: Grades and lengths as they stand in pages. Fixed values.
_FRENCH = re.compile(r"^([1-9][abc][+]?|\?)")
_GRADE = re.compile(
    r"\b(E\d+(?:/\d+)?(?: [3-7][abc][+]?)?|XS|HVS(?: [3-7][abc][+]?)?|VS(?: [3-7][abc][+]?)?|HS(?: [3-7][abc][+]?)?|MS|VD(?:iff)?|"
    r"Hard Severe|Mild Severe|Severe|Diff|Moderate|S(?: [3-7][abc][+]?)?|D\b|M\b|f?[3-8][abc]?\+?|A\d)\b"
)
_BRITISH = re.compile(r"^(E\d|XS|HVS|VS|HS|MS|VD|S|D|M|Hard|Mild|Severe|Diff|Moderate)")
_METRES = re.compile(r"\b(\d{1,3})\s*m\b")


@dataclass(frozen=True)
class Adapter:
    """``parse(item, page)`` gives {name, lat, lon, description, box, routes, next}; what it leaves out is empty."""

    source_id: str
    parse: Callable[[dict, str], dict]


def _whole(value) -> int | None:
    return None if value in (None, "") else int(value)


def _tree_page(item: dict, page: str) -> dict:
    """A page of an area tree: its box and point, its routes as records in attributes, or else the areas below it."""
    box = _BOX.search(page)
    point = {k: float(v) for k, v in _POINT.findall(page)}
    routes = []
    for found in markup.attribute_records(page, "div", "route", "data-route-tick", "/route/"):
        r = json.loads(found["record"])
        style, height = STYLES.get((r.get("styleStub") or "").strip()), r.get("displayHeight")
        routes.append({
            "source_id": str(r["id"]), "name": r["name"], "grade": (r.get("gradeAtom") or {}).get("grade") or None,
            "length_m": height[0] if isinstance(height, list) and height else None, "pitches": _whole(r.get("pitches") or None), "stars": _whole(r.get("stars")),
            "disciplines": [style] if style else [], "url": found["href"], "description": "",
        })
    out = {"lat": point.get("latitude"), "lon": point.get("longitude"), "routes": routes, "next": []}
    if box:
        a, b, c, d = map(float, box.groups())
        out["box"] = (min(a, c), min(b, d), max(a, c), max(b, d))
    title, seen = None, {}
    listed, link, name = 0, None, []  # within a list that holds the areas below
    for what, tag, value in markup.events(page):
        if tag == "title" and what == "text":
            title = title or value.split(",")[0].strip()
        elif tag == "ul" and what == "open":
            listed = listed + 1 if listed or "embed-menu" not in value.get("class", "").split() else -1000
        elif tag == "ul" and what == "close":
            listed = 0 if listed < 0 else max(0, listed - 1)
        elif tag == "a" and what == "open" and listed > 0 and "data-nid" in value:
            link, name = value.get("href", "").split("#")[0].rstrip("/"), []
        elif tag == "a" and what == "close":
            if link and name and not routes:
                seen.setdefault(link, "".join(name).strip())
            link = None
        elif what == "text" and link and tag == "span":
            name.append(value)
    out["name"] = title
    out["next"] = [{"url": u, "name": n} for u, n in seen.items()]
    return out


def _table_page(item: dict, page: str) -> dict:
    """A page with a table of routes: the link names a route, the first cell like a French grade grades it, the cell before the
    last two is a note. Such pages hold no coordinates, and none are guessed."""
    routes = []
    for row in markup.heading_rows(page):
        number = re.search(r"/vie/(\d+)/", row["href"] or "")
        if not number:
            continue
        cells = row["cells"]
        graded = next((m[0] for c in cells if (m := _FRENCH.match(c))), "?")
        note = cells[-3] if len(cells) >= 3 else ""
        known = graded != "?"
        routes.append({
            "source_id": number[1], "name": cells[0] if cells else "", "grade": graded if known else None, "grade_system": "french" if known else None,
            "disciplines": ["sport"], "url": row["href"], "description": "" if _FRENCH.match(note) else note,
        })
    return {"name": item.get("name"), "routes": routes}


def _register_page(item: dict, page: str) -> dict:
    """A page that names its routes in bold: a bold text is a route if what follows soon has a grade or a length."""
    (before, *bold), routes = markup.bold_entries(page), []
    for entry in bold:
        head, label = entry["text"][:110], entry["name"]
        grade, metres = _GRADE.search(head), _METRES.search(head)
        if not label or len(label) > 80 or not (grade or metres):
            continue
        routes.append({
            "source_id": f"{item.get('id')}#{len(routes) + 1}", "name": label.replace("*", "").strip(" ."), "grade": grade[1] if grade else None,
            "grade_system": "uk_adjectival_tech" if grade and _BRITISH.match(grade[1]) else None, "length_m": int(metres[1]) if metres else None, "stars": label.count("*") or None,
            "disciplines": ["trad"], "url": item.get("url"), "description": entry["text"][:800],
        })
    return {"name": item.get("name"), "description": before["text"][:700], "routes": routes}


_GPS = re.compile(r"maps\.google\.com/maps\?q=(-?\d+\.\d+),(-?\d+\.\d+)")
_STONE = re.compile(r"[Rr]occia\s+([A-Za-zÀ-ú ]{3,25})")


def _card_page(item: dict, page: str) -> dict:
    """A page that describes a place without its routes: a map link's point and the first four long paragraphs, each once."""
    gps, prose, parts, depth = _GPS.search(page), [], [], 0
    for what, tag, value in markup.events(page):
        if tag == "p" and what in ("open", "close"):
            paragraph = re.sub(r"\s+", " ", "".join(parts)).strip()
            if depth and len(paragraph) > 60 and not paragraph.lower().startswith(("cookie", "questo sito")):
                prose.append(paragraph)
            parts, depth = [], int(what == "open")
        elif what == "text" and depth and tag not in ("script", "style"):
            parts.append(value)
    stone = _STONE.search(page)
    point = (float(gps[1]), float(gps[2])) if gps else (None, None)
    return {"name": item.get("name"), "lat": point[0], "lon": point[1], "description": "\n\n".join(dict.fromkeys(prose[:4])), "rock": STONES.get(stone[1].strip().lower().split(" e ")[0]) if stone else None}


REGISTRY = {a.source_id: a for a in (Adapter("area_tree", _tree_page), Adapter("route_table", _table_page), Adapter("route_register", _register_page), Adapter("place_card", _card_page))}


def problems(place: dict) -> list[str]:
    """What is off the schema; a place without a name, a route without a name or id, coordinates out of range."""
    out = [] if place.get("name") else ["no name"]
    for key, most in (("lat", 90), ("lon", 180)):
        if place.get(key) is not None and not -most <= place[key] <= most:
            out.append(f"{key} out of range")
    out += ["route without a name" for r in place["routes"] if not r.get("name")][:1]
    return out + ["route without an id" for r in place["routes"] if not r.get("source_id")][:1]


def _place(adapter: Adapter, item: dict) -> dict:
    """One row of SCHEMA for a landed item."""
    row = dict.fromkeys(_NAMES) | {"source": adapter.source_id, "item": item.get("url") or item.get("id"), "url": item.get("url"), "routes": [], "next": []}
    try:
        found = {"routes": [], "next": []} | adapter.parse(item, item.get("payload") or "")
        found["name"] = found.get("name") or item.get("name")
        wrong = problems(found)
        if wrong:
            return row | {"rejected": "; ".join(wrong)}
        row |= dict(zip(("south", "west", "north", "east"), found.pop("box", (None,) * 4)))
        return row | {k: v for k, v in found.items() if k in row}
    except Exception as e:  # a page that can't be read must not stop the others
        return row | {"rejected": f"{type(e).__name__}: {e}"[:500]}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


@dataclass
class _Lines(InputPartition):
    path: str
    first: int
    last: int


class _Reader(DataSourceReader):
    #: Bytes of a file that one task reads.
    RANGE = 32 << 20

    def __init__(self, schema: StructType, options: dict):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.folder, self.arrow = options["path"], to_arrow_schema(schema)
        if options.get("source") not in REGISTRY:
            raise ValueError(f"source: one of {', '.join(sorted(REGISTRY))}")
        self.source = options["source"]

    def _files(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.folder) if re.match(r"[a-z0-9]+:", self.folder) else (pafs.LocalFileSystem(), self.folder)

    def partitions(self) -> list[_Lines]:
        """Byte ranges; a line belongs to the range that it begins in."""
        fs, folder = self._files()
        found = fs.get_file_info(pafs.FileSelector(folder, recursive=True))
        data = sorted((i.path, i.size) for i in found if i.is_file and not i.base_name.startswith(("_", ".")))
        out = [_Lines(path, at, min(size, at + self.RANGE)) for path, size in data for at in range(0, size, self.RANGE)]
        return out or [_Lines("", 0, 0)]

    def read(self, partition: _Lines) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        adapter, rows = REGISTRY[self.source], []
        with io.BufferedReader(self._files()[0].open_input_file(partition.path), 1 << 20) as f:
            at = partition.first
            f.seek(at)
            if at:  # the rest of a line that began before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < partition.last and (line := f.readline()):
                at += len(line)
                try:
                    item = json.loads(line)
                    if not isinstance(item, dict):
                        raise ValueError("no item")
                except (ValueError, RecursionError) as e:
                    item = None
                    rows.append(dict.fromkeys(_NAMES) | {"source": self.source, "routes": [], "next": [], "rejected": f"not JSON: {e}"[:500]})
                if item is not None:
                    rows.append(_place(adapter, item))
                if len(rows) >= 200:
                    yield _batch(rows, self.arrow)
                    rows = []
        if rows:
            yield _batch(rows, self.arrow)


class LandedSource(DataSource):
    """``landed_source``: options path and source (a name in REGISTRY)."""

    @classmethod
    def name(cls) -> str:
        return "landed_source"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def parsed(landed: DataFrame, source: str) -> DataFrame:
    """The same rows from a table of landed items, wherever Spark read it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema, adapter = to_arrow_schema(_parse_datatype_string(SCHEMA)), REGISTRY[source]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                yield _batch([_place(adapter, item) for item in batch.slice(at, 200).to_pylist()], schema)

    return landed.select("kind", "id", "url", "name", "payload").mapInArrow(run, SCHEMA)
