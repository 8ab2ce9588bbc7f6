"""Scores, ranks and their movement, best choices within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.lineage import numbered_within

#: Shares of weather, travel and fit in a composite score. Fixed values.
WEIGHTS = {"weather": 0.65, "travel": 0.15, "fit": 0.20}


def weighted_mean(pairs: list[tuple[Column, Column | float]]) -> Column:
    """Over values that are there and have a weight; null without any. Rounded to whole numbers."""
    total = weight = F.lit(0.0)
    for value, w in pairs:
        w = F.lit(w) if not isinstance(w, Column) else w
        counts = value.isNotNull() & (F.coalesce(w, F.lit(0.0)) != 0)
        total = total + F.when(counts, value * w).otherwise(0.0)
        weight = weight + F.when(counts, w).otherwise(0.0)
    return F.when(weight != 0, F.bround(total / weight))


def composite(weather: Column, travel: Column, fit: Column, preferences: dict[str, float] | None = None) -> Column:
    """Weighted sum of three scores, normalised; -1 where there is no weather score. Travel and fit without data weigh nothing."""
    w = {k: v * (preferences or {}).get(k, 1.0) for k, v in WEIGHTS.items()}
    score = weighted_mean([(weather, w["weather"]), (travel, w["travel"]), (fit, w["fit"])])
    return F.when(F.coalesce(weather, F.lit(-1)) < 0, F.lit(-1.0)).otherwise(score)


def best_first(rows: DataFrame, score: str, priority: str, ordinal: str, within: list[str] | None = None) -> DataFrame:
    """Rank by score, priority, input order; rows without a score (below 0) come last in input order.

    Numbered in many tasks, also within a key of very many rows or over all rows (without ``within``).
    """
    failed = F.col(score) < 0
    order = [failed.asc(), F.when(~failed, F.col(score)).desc(), F.when(~failed, F.col(priority)).asc(), F.col(ordinal).asc()]
    return numbered_within(rows, within or [], order, "rank").withColumn("rank", F.col("rank").cast("int"))


def movement(history: DataFrame) -> DataFrame:
    """(run_date, rank, name) to each row's gain against the latest earlier day that has rows, and whether it is new then."""
    dates = history.select("run_date").distinct()
    before = dates.withColumn("prev_date", F.lag("run_date").over(Window.orderBy("run_date")))  # a row for each day
    earlier = history.select(F.col("run_date").alias("prev_date"), "name", F.col("rank").alias("prev_rank"))
    joined = history.join(before, "run_date").join(earlier, ["prev_date", "name"], "left")
    return joined.select("run_date", "rank", "name", (F.col("prev_rank") - F.col("rank")).alias("rank_delta"), (F.col("prev_date").isNotNull() & F.col("prev_rank").isNull()).alias("rank_new"))


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key in an order that must have no ties."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def best_flights(options: DataFrame, k: int = 3, per_stop: int = 40) -> DataFrame:
    """The k options of best value for each venue and traveller: price and a charge for each stop; repeats count once."""
    value = (F.col("price") + per_stop * F.col("stops")).asc()
    once = first_of_each(options, ["venue", "traveller", "from", "dep", "price"], [value, F.col("ord").asc()])
    return once.withColumn("pos", F.row_number().over(Window.partitionBy("venue", "traveller").orderBy(value, F.col("ord").asc()))).where(F.col("pos") <= k)


def flex_saving(alternatives: DataFrame, base: DataFrame) -> DataFrame:
    """The cheapest priced alternative of each venue and traveller, if below the base price, and what it saves."""
    best = alternatives.where("price IS NOT NULL").groupBy("venue", "traveller").agg(F.min(F.struct("price", "ord", "shift")).alias("b"))
    joined = best.join(base.select("venue", "traveller", F.col("price").alias("base_price")), ["venue", "traveller"])
    return joined.where("b.price < base_price").select("venue", "traveller", F.col("b.shift").alias("shift"), F.col("b.price").alias("price"), (F.col("base_price") - F.col("b.price")).alias("saving"))


def flex_line(savings: DataFrame) -> DataFrame:
    """A line for each traveller with a saving: the venue where other days save most (ties: the first venue) and how much."""
    best = savings.groupBy("traveller").agg(F.min_by(F.struct("venue", "shift", "price", "saving"), F.struct(-F.col("saving"), "venue")).alias("b"))
    days = F.format_string("%+d", F.col("b.shift").cast("int"))
    return best.select("traveller", F.concat_ws("", F.col("traveller"), F.lit(": "), days, F.lit(" days to "), F.col("b.venue").cast("string"), F.lit(" saves "), F.bround("b.saving").cast("int").cast("string")).alias("line"))


def capped_picks(rows: DataFrame, key: list[str], order: list[Column], group: str, group_cap: dict[str, int], cap: int) -> DataFrame:
    """The first ``cap`` rows of each key after at most ``group_cap`` rows of some groups; order must have no ties."""
    within = F.row_number().over(Window.partitionBy(*key, group).orderBy(*order))
    limit = F.coalesce(F.create_map(*[F.lit(x) for p in group_cap.items() for x in p])[F.col(group)], F.lit(1 << 30))
    kept = rows.withColumn("_g", within).where(F.col("_g") <= limit).drop("_g")
    return first_of_each(kept, key, order, cap)


def collision_numbers(rows: DataFrame, key: list[str], order: list[Column]) -> Column:
    """'' for the first row of a key, then --2, --3 and so on."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return F.when(n == 1, "").otherwise(F.concat(F.lit("--"), n.cast("string")))


def islands(rows: DataFrame, key: list[str], order: list[Column], value: str) -> DataFrame:
    """Runs of equal values along an order: key, value, run, first and last position and length."""
    along = Window.partitionBy(*key).orderBy(*order)
    marked = rows.withColumn("_pos", F.row_number().over(along)).withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(along)) | (F.col("_pos") == 1)).cast("int"))
    return marked.withColumn("run", F.sum("_new").over(along)).groupBy(*key, "run", value).agg(F.min("_pos").alias("first"), F.max("_pos").alias("last"), F.count("*").alias("n"))


def upper_median(value: str) -> Column:
    """Aggregate over a column of numbers: the middle value, of two the larger. It counts by value, so no list of a group is built."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)")
