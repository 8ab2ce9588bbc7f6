"""What pages hold: JSON in scripts and attributes, tables and bold entries with the heading that they stand under.

Nothing built in parses HTML, so these are pandas functions; each reads a page once, from its start to its end.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HIDDEN = {"script", "style"}
_HEADING = re.compile(r"h[1-6]$")


class _Events(HTMLParser):
    """A page as (kind, tag, value): opened with its attributes, closed, and text with the innermost element's tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple] = []
        self.open: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.found.append(("open", tag, {k: v or "" for k, v in attrs}))
        if tag not in _VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.found.append(("open", tag, {k: v or "" for k, v in attrs}))
        self.found.append(("close", tag, None))

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        self.found.append(("close", tag, None))

    def handle_data(self, data):
        self.found.append(("text", self.open[-1] if self.open else "", data))


def events(page: str | None) -> list[tuple]:
    reader = _Events()
    reader.feed(page or "")
    reader.close()
    return reader.found


def _plain(parts: list[str]) -> str:
    return re.sub(r"\s+", " ", "".join(parts)).strip()


def attribute_records(page: str | None, tag: str, kind: str, attribute: str, link: str) -> list[dict]:
    """Records in an attribute of elements of a class: (record: JSON text, href of the first link within that holds ``link``).

    Values that aren't JSON are left out. An element ends where its own tag closes.
    """
    out: list[dict] = []
    inside: list[tuple[int, dict]] = []  # depth of the tag at which an element opened
    depth = 0
    for what, name, value in events(page):
        if what == "open" and name == tag:
            depth += 1
            if attribute in value and kind in value.get("class", "").split():
                text = html.unescape(value[attribute])
                if _is_json(text):
                    out.append({"record": text, "href": None})
                    inside.append((depth, out[-1]))
        elif what == "close" and name == tag and depth:
            depth -= 1
            inside = [x for x in inside if x[0] <= depth]
        elif what == "open" and name == "a" and link in value.get("href", ""):
            for _, record in inside:
                record["href"] = record["href"] or value["href"]
    return out


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):  # nested too deep to be read
        return False
    return True


def bracketed(page: str | None, marker: str) -> str | None:
    """The JSON array after a marker in a script, by counting brackets outside strings; None if there is none, it never
    closes (a truncated page) or it isn't JSON."""
    at = (page or "").find(marker + "[")
    if at < 0:
        return None
    start = at + len(marker)
    depth, quote = 0, ""
    # Only quotes, brackets and what a backslash escapes matter.
    for m in re.compile(r"\\.|[\"'\[\]]", re.S).finditer(page, start):
        c = m[0]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[]":
            depth += 1 if c == "[" else -1
            if not depth:
                text = page[start : m.end()]
                return text if _is_json(text) else None
    return None


def heading_rows(page: str | None) -> list[dict]:
    """Rows of tables in order: (heading they stand under, its level, cells, href of the first link). No heading yet: null, 0."""
    out, heading, level = [], None, 0
    title: list[str] | None = None
    cells: list[list[str]] | None = None
    cell = href = None
    for what, tag, value in events(page):
        if what == "open":
            if _HEADING.match(tag):
                title, rank = [], int(tag[1])
            elif tag == "tr":
                cells, cell, href = [], None, None
            elif tag in ("td", "th") and cells is not None:
                cell = []
                cells.append(cell)
            elif tag == "a" and cells is not None:
                href = href or value.get("href")
            elif tag == "br" and cell is not None:
                cell.append(" ")
        elif what == "close":
            if title is not None and _HEADING.match(tag):
                heading, level, title = _plain(title), rank, None
            elif tag == "tr" and cells is not None:
                out.append({"heading": heading, "level": level, "cells": [_plain(c) for c in cells], "href": href})
                cells = None
            elif tag in ("td", "th"):
                cell = None
        elif tag not in _HIDDEN:
            if title is not None:
                title.append(value)
            elif cell is not None:
                cell.append(value)
    return out


def bold_entries(page: str | None) -> list[dict]:
    """Bold texts in order with the text from each to the next: (name, text). The first has a null name: what stands before."""
    out, parts, name = [{"name": None, "text": ""}], [], None
    for what, tag, value in events(page):
        if tag == "b" and what == "open":
            out[-1]["text"] = _plain(parts)
            out.append({"name": "", "text": ""})
            name, parts = [], []
        elif tag == "b" and what == "close" and name is not None:
            out[-1]["name"], name = _plain(name), None
        elif what == "text" and tag not in _HIDDEN:
            (parts if name is None else name).append(value)
    if name is not None:
        out[-1]["name"] = _plain(name)
    out[-1]["text"] = _plain(parts)
    return out


def _each(of: Callable, kind: str, page: Column) -> Column:
    @F.pandas_udf(kind)
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in pages:
            yield pd.Series([of(p) for p in some], dtype="object")

    return run(page)


def attribute_json(page: Column, tag: str, kind: str, attribute: str, link: str) -> Column:
    return _each(lambda p: attribute_records(p, tag, kind, attribute, link), "array<struct<record: string, href: string>>", page)


def bracketed_json(page: Column, marker: str) -> Column:
    return _each(lambda p: bracketed(p, marker), "string", page)


def table_rows(page: Column) -> Column:
    return _each(heading_rows, "array<struct<heading: string, level: int, cells: array<string>, href: string>>", page)


def bold_texts(page: Column) -> Column:
    return _each(bold_entries, "array<struct<name: string, text: string>>", page)
