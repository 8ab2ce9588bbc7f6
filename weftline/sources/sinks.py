"""Writers: Spark's commit protocol makes each of them all or nothing for each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.dashboard import nested_documents
from weftline.operators.lineage import written
from weftline.operators.ranking import first_of_each


def nested_export(areas: DataFrame, routes: DataFrame, area_key: str = "area_id", bound: int = 10_000) -> DataFrame:
    """JSON texts of areas with their routes in order (name, then the rest) and their counts by status.

    An area of more than ``bound`` routes comes as several documents, each with ``page`` and ``pages`` and the next of its
    routes; others are one document without these.
    """
    fields = ["name", *[c for c in routes.columns if c not in (area_key, "name")]]
    counts = routes.groupBy(F.col(area_key).alias("id")).agg(F.count("*").alias("n_routes"), F.count_if(F.col("status") == "publish").alias("n_published"))
    listed = routes.select(F.col(area_key).alias("id"), *fields)
    paged = nested_documents(areas.join(counts, "id", "left"), "id", {"routes": (listed, ["name"])}, bound)
    whole = F.col("pages") == 1
    own = [c for c in areas.columns] + ["routes", "n_routes", "n_published"]
    shown = paged.withColumns({c: F.when(~whole, F.col(c)) for c in ("page", "pages")})
    return shown.select("id", F.to_json(F.struct(*own, "page", "pages")).alias("document"))


def spread(rows: DataFrame, levels: list[str], heavy: int = 1_000_000) -> DataFrame:
    """``rows`` dealt out by their levels, those of a value with very many over several tasks of about ``heavy`` rows each."""
    named = [F.col(level).alias(f"_level{i}") for i, level in enumerate(levels)]
    sizes = rows.groupBy(*named).agg(F.ceil(F.count("*") / heavy).cast("int").alias("_parts"))
    same = F.lit(True)
    for i, level in enumerate(levels):
        same &= F.col(level).eqNullSafe(F.col(f"_level{i}"))
    dealt = rows.join(sizes, same).select(*rows.columns, F.floor(F.rand(1) * F.col("_parts")).alias("_part"))
    return dealt.repartition(*levels, "_part").drop("_part")


def write_tree(rows: DataFrame, path: str, levels: list[str]) -> None:
    """JSON lines under a folder for each value of the levels, so that readers prune by them; a hot value gives several files."""
    spread(written(rows), levels).write.partitionBy(*levels).mode("overwrite").json(path)


def write_keyed(rows: DataFrame, path: str, levels: list[str], flagged: Column) -> None:
    """Rows as trees below ``kept`` and ``flagged``, and a ``report``: how many went where for each value of the levels.

    The rows are made once, for all three.
    """
    marked = written(rows.withColumn("_flag", F.coalesce(flagged, F.lit(False))))
    for name, some in (("kept", ~F.col("_flag")), ("flagged", F.col("_flag"))):
        spread(marked.where(some).drop("_flag"), levels).write.partitionBy(*levels).mode("overwrite").json(f"{path}/{name}")
    counts = marked.groupBy(*levels).agg(F.count_if(~F.col("_flag")).alias("n_kept"), F.count_if("_flag").alias("n_flagged"))
    counts.write.mode("overwrite").json(f"{path}/report")


def write_days(rows: DataFrame, path: str, run_date: str = "run_date") -> None:
    """Parquet by run date; only the dates at hand are replaced."""
    rows.write.partitionBy(run_date).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def capped_history(history: DataFrame, new: DataFrame, key: list[str], order: Column, cap: int = 180) -> DataFrame:
    """History with new rows, the latest ``cap`` of each key."""
    return first_of_each(history.unionByName(new), key, [order.desc()], cap)


def report_lines(ranked: DataFrame) -> DataFrame:
    """A line of a Markdown table for each ranked row."""
    move = F.when(F.col("rank_new"), "new").when(F.col("rank_delta") > 0, F.concat(F.lit("+"), F.col("rank_delta").cast("string"))).otherwise(F.coalesce(F.col("rank_delta").cast("string"), F.lit("")))
    return ranked.orderBy("rank").select(F.format_string("| %d | %s | %d | %s |", F.col("rank"), F.col("name"), F.col("score"), move).alias("value"))


def taxonomy_sql(vocabulary: DataFrame, table: str) -> DataFrame:
    """An upsert statement for each word of a vocabulary, in order."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'"))
    line = F.concat(F.lit(f"INSERT INTO {table} (code, meaning, sort_order) VALUES ("), quoted("code"), F.lit(", "), quoted("meaning"), F.lit(", "), F.col("sort_order").cast("string"), F.lit(") ON CONFLICT (code) DO UPDATE SET meaning = EXCLUDED.meaning, sort_order = EXCLUDED.sort_order;"))
    return vocabulary.orderBy("sort_order", "code").select(line.alias("value"))
