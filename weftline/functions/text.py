"""Names, slugs, links and markup as column expressions; pandas only where nothing built in has the semantics."""

from __future__ import annotations

import difflib
import html
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Latin letters that decompose into a letter and marks, and those letters; ß, ø, æ and the like don't.
_MARKED = "".join(c for c in map(chr, range(0xC0, 0x250)) if unicodedata.decomposition(c) and unicodedata.normalize("NFD", c)[0].isascii())
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)


def fold(text: Column) -> Column:
    """Letters without their marks; combining marks go."""
    return F.regexp_replace(F.translate(text, _MARKED, _PLAIN), r"\p{M}+", "")


def slug(text: Column, folded: bool = True, ascii_only: bool = False, cut: int | None = None, default: str | None = None) -> Column:
    """Lower-case words joined by hyphens.

    ``folded`` drops marks from letters first, ``ascii_only`` then drops what is still not ASCII (else it becomes a
    hyphen), ``cut`` bounds the length, and ``default`` stands for an empty result.
    """
    base = fold(text) if folded else text
    if ascii_only:
        base = F.regexp_replace(base, r"[^\x00-\x7F]", "")
    made = F.regexp_replace(F.regexp_replace(F.lower(base), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    if cut:
        made = F.regexp_replace(F.substring(made, 1, cut), "-+$", "")
    return made if default is None else F.when(made == "", default).otherwise(made)


def norm_name(text: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Folded lower-case words, single-spaced; stop words go."""
    words = F.filter(F.split(F.regexp_replace(F.lower(fold(text)), "[^a-z0-9]+", " "), " "), lambda w: (w != "") & ~w.isin(*stop_words) if stop_words else w != "")
    return F.array_join(words, " ")


def tokens(text: Column, stop_words: tuple[str, ...] = ()) -> Column:
    return F.array_distinct(F.filter(F.split(norm_name(text, stop_words), " "), lambda w: w != ""))


def token_subset(a: Column, b: Column) -> Column:
    """Whether either's words are all among the other's."""
    return (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks, twice over both lengths; no built-in function has it."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML character references resolved twice, as some sources escape twice."""
    return text.map(lambda t: None if t is None else html.unescape(html.unescape(t)))


def strip_tags(text: Column) -> Column:
    """Text of HTML: breaks and paragraphs end lines, other tags go, blanks are squeezed."""
    lines = F.regexp_replace(text, r"(?i)<br\s*/?>|</p>", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(lines, "(?s)<[^>]*>", ""), r"[ \t]+", " "))


def short_name(name: Column) -> Column:
    return F.trim(F.substring_index(F.substring_index(name, "(", 1), ",", 1))


def search_name(name: Column) -> Column:
    """What stands in brackets, else the name without a trailing region."""
    inner = F.regexp_extract(name, r"\(([^)]+)\)", 1)
    return F.trim(F.when(inner != "", inner).otherwise(F.regexp_replace(name, r",\s*NI\s*$", "")))


def route_slug(name: Column, status: Column) -> Column:
    """Link of a published route; letters keep their marks."""
    made = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[\s/]+", "-"), r"[?#%\"']", "")
    return F.when(status == "publish", made)


def region_slug(text: Column) -> Column:
    return F.regexp_replace(slug(text), "^(?:co|county)-", "")


def first_number(text: Column) -> Column:
    return F.regexp_substr(text, F.lit("[0-9]+")).try_cast("int")


def first_digit(text: Column, default: int = 9) -> Column:
    return F.coalesce(F.regexp_substr(text, F.lit("[0-9]")).try_cast("int"), F.lit(default))


def site_kind(url: Column, social: tuple[str, ...], forums: tuple[str, ...]) -> Column:
    """social, forum or web, by a link's host."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www\\.", "")
    within = lambda names: F.exists(F.array(*map(F.lit, names)), lambda n: (host == n) | host.endswith(F.concat(F.lit("."), n)))
    return F.when(within(social), "social").when(within(forums) | F.coalesce(host.startswith("forum"), F.lit(False)), "forum").otherwise("web")


def item_key(kind: Column, ident: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", kind, ident)), 1, 16)


def text_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 10)


def unfence(text: Column) -> Column:
    """What a fenced block holds, else the text."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(inner != "", inner).otherwise(F.trim(text))


def redact(text: Column) -> Column:
    """Values of key-like parameters in links become ***."""
    return F.regexp_replace(text, r"(?i)([?&](?:api_?key|key|token|secret)=)[^&\s]+", "$1***")


def reference_source(ref: Column, sources: tuple[str, ...]) -> Column:
    """(source, id) of ``source-id`` references whose source is known."""
    source = F.lower(F.substring_index(ref, "-", 1))
    return F.when(source.isin(*sources), F.struct(source.alias("source"), F.regexp_replace(ref, "^[^-]*-", "").alias("id")))


def pitches(text: Column) -> Column:
    """``[P1: 30m, 5a] words`` marks to an array of (number, length, grade, words)."""
    pattern = r"\[P([0-9]+):\s*([0-9]+)m,\s*([^\]]+)\]\s*([^\[]*)"
    part = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("number"), part(2).alias("length"), part(3).alias("grade"), part(4).alias("words"))
    return F.transform(zipped, lambda p: F.struct(p["number"].cast("int").alias("number"), p["length"].cast("int").alias("length_m"), F.trim(p["grade"]).alias("grade"), F.trim(p["words"]).alias("words")))


def truthy(flag: Column) -> Column:
    return F.coalesce(F.lower(flag.cast("string")).isin("1", "true"), F.lit(False))


def typed_int(text: Column) -> Column:
    return text.try_cast("int")


def canonical(text: Column, aliases: dict[str, str], known: list[str]) -> Column:
    """A vocabulary's word for a text: by alias, else itself if known, else null. Notes in brackets don't count."""
    low = F.lower(F.trim(F.regexp_replace(text, r"\([^)]*\)", "")))
    named = F.coalesce(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[low], low) if aliases else low
    return F.when(named.isin(known), named)


@F.pandas_udf(T.StringType())
def balanced_json(text: pd.Series, marker: pd.Series) -> pd.Series:
    """The JSON value that follows a marker in a page's script; brackets within strings don't count."""

    def one(t: str | None, m: str) -> str | None:
        at = -1 if t is None else t.find(m)
        if at < 0:
            return None
        starts = [i for i in (t.find("{", at + len(m)), t.find("[", at + len(m))) if i >= 0]
        try:
            value, _ = json.JSONDecoder().raw_decode(t, min(starts)) if starts else (None, 0)
        except ValueError:
            return None
        return None if value is None else json.dumps(value)

    return pd.Series([one(t, m) for t, m in zip(text, marker)], dtype="object")
