"""Mentions of places on the web: what is relevant, what comes first, what they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import fold, norm_name


def host_within(host: Column, names: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, names)), lambda n: (host == n) | host.endswith(F.concat(F.lit("."), n))) if names else F.lit(False)


def relevant(host: Column, link: Column, visible: Column, place: Column, blocked: list[str], blocked_suffixes: list[str], path_rules: dict[str, list[str]], trusted: list[str], words: list[str]) -> Column:
    """Whether a mention stays, by the first rule that speaks: blocked hosts and suffixes go, some hosts stay by their paths
    alone, trusted hosts stay, and all others must show the place's name and a word of the sport."""
    low = F.lower(host)
    bare = F.regexp_replace(low, "^www\\.", "")
    path = F.coalesce(F.try_parse_url(link, F.lit("PATH")), F.lit(""))
    text = norm_name(visible)
    shows = text.contains(norm_name(place)) & (F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w)) if words else F.lit(False))
    out = F.when(bare.isin(blocked) | (F.exists(F.array(*map(F.lit, blocked_suffixes)), lambda s: low.endswith(s)) if blocked_suffixes else F.lit(False)), False)
    for part, allowed in path_rules.items():
        out = out.when(low.contains(part), F.exists(F.array(*map(F.lit, allowed)), lambda p: path.contains(p)))
    return out.when(host_within(low, trusted), True).otherwise(F.coalesce(shows, F.lit(False)))


def mention_order(host: Column, kind: Column, days_ago: Column, trusted: list[str]) -> list[Column]:
    """Trusted hosts and forums first, then by age, undated last."""
    boost = F.when(host_within(F.lower(host), trusted) | (kind == "forum"), 0).otherwise(1)
    return [boost.asc(), days_ago.isNull().asc(), F.coalesce(days_ago, F.lit(0)).asc()]


def named_places(docs: DataFrame, places: DataFrame, least: int = 4) -> DataFrame:
    """(doc, place) for names of at least ``least`` letters that occur in a text as whole words, whatever their case.

    A name meets a text by its rarest word among the names, one row for each of a text's different words, so that no text is
    held against every name and no run of words is made. Names of several words are then looked for in the texts that they met.
    Documents that repeat an id are one for each different text.
    """
    words = lambda c: F.filter(F.split(F.lower(fold(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    names = places.where(F.length("name") >= least).select("place", words(F.col("name")).alias("w")).where(F.size("w") > 0)
    each = names.select("place", "w", F.explode(F.array_distinct("w")).alias("word"))
    often = each.groupBy("word").agg(F.count("*").alias("n"))
    keyed = each.join(often, "word").groupBy("place", "w").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    keyed = keyed.select("place", "word", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("phrase"), (F.size("w") > 1).alias("several"))
    held = docs.select("doc", F.concat(F.lit(" "), F.array_join(words(F.col("text")), " "), F.lit(" ")).alias("text"))
    seen = held.select("doc", F.xxhash64("text").alias("hash"), F.explode(F.array_distinct(F.split(F.trim("text"), " "))).alias("word"))
    # The words grow with the texts: merged, unless at run time one side is small enough to be sent around.
    met = seen.hint("merge").join(keyed, "word")
    alone = met.where(~F.col("several")).select("doc", "place")
    asked = met.where("several").select("doc", "hash", "place", "phrase").distinct()
    whole = held.withColumn("hash", F.xxhash64("text")).hint("merge").join(asked, ["doc", "hash"]).where(F.contains("text", F.col("phrase"))).select("doc", "place")
    return alone.unionByName(whole).distinct()


def common_links(mentions: DataFrame, more_than: int = 1) -> DataFrame:
    """Links that several places share; they tell of none."""
    return mentions.groupBy("link").agg(F.count_distinct("venue").alias("n")).where(F.col("n") > more_than)


def link_health(checks: DataFrame, horizon_days: int = 14) -> DataFrame:
    """(url, day, status) to whether each link is dead and when to look again.

    404, 410 and a host without an address (status 0) are dead at once; other failures only if the two latest checks
    failed on different days.
    """
    failed, gone = F.col("status") >= 400, F.col("status").isin(404, 410, 0)
    latest = checks.groupBy("url").agg(
        F.max_by("status", "day").alias("status"),
        F.max("day").alias("day"),
        F.max(F.when(~(failed | gone), F.col("day"))).alias("last_good"),
        F.count_distinct(F.when(failed, F.col("day"))).alias("_n"),
        F.collect_set(F.when(failed & ~gone, F.col("day"))).alias("_bad"),
    )
    again = F.size(F.filter("_bad", lambda d: F.col("last_good").isNull() | (d > F.col("last_good")))) >= 2
    dead = F.col("status").isin(404, 410, 0) | ((F.col("status") >= 400) & again)
    return latest.select("url", "status", "day", dead.alias("dead"), F.date_add("day", horizon_days).alias("recheck"))
