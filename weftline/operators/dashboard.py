"""Documents that nest several child tables under one parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.lineage import numbered_within

#: Rows of one child table in a document at most.
BOUND = 500


def nested_documents(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[str]]], bound: int = BOUND) -> DataFrame:
    """(key, page, pages, the parent's columns, an array for each child table): whole parents in one or several documents.

    ``children``: name to (table with ``key``, columns to order by). All child rows go through one shuffle as texts with their
    table's name, are numbered within parent and table, and come together again by parent and page. A page holds at most
    ``bound`` rows of each child table; what is beyond goes to further pages, so no row is dropped and no array grows with a
    parent. A parent without children has one page of empty arrays. Children of unknown parents are left out; rows of equal
    order stand in the order of their content.
    """
    kinds = {name: table.select(*[c for c in table.columns if c != key]).schema.simpleString() for name, (table, _) in children.items()}
    pieces = None
    for name, (table, order) in children.items():
        own = [c for c in table.columns if c != key]
        sort = F.array(*[_sortable(table, c) for c in order])
        some = table.select(F.col(key).alias("_key"), F.lit(name).alias("_kind"), sort.alias("_order"), F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("_row"))
        pieces = some if pieces is None else pieces.unionByName(some)
    known = pieces.join(parents.select(F.col(key).alias("_key")), "_key", "left_semi")
    placed = numbered_within(known, ["_key", "_kind"], [F.col("_order").asc(), F.col("_row").asc()], "_n")
    paged = placed.withColumn("page", F.floor((F.col("_n") - 1) / bound).cast("int") + 1)
    lists = [F.array_sort(F.collect_list(F.when(F.col("_kind") == name, F.struct("_n", "_row")))).alias(name) for name in children]  # at most ``bound``
    held = paged.groupBy("_key", "page").agg(*lists)
    pages = held.groupBy("_key").agg(F.max("page").alias("pages"))
    joined = parents.join(pages, parents[key] == pages["_key"], "left").drop("_key").withColumn("pages", F.coalesce("pages", F.lit(1)))
    every = joined.withColumn("page", F.explode(F.sequence(F.lit(1), F.col("pages"))))
    full = every.join(held.withColumnRenamed("_key", "_held").withColumnRenamed("page", "_page"), (F.col(key) == F.col("_held")) & (F.col("page") == F.col("_page")), "left")
    rows = lambda name: F.transform(F.coalesce(F.col(name), F.array()), lambda x: F.from_json(x["_row"], kinds[name]))
    return full.select(key, "page", "pages", *[c for c in parents.columns if c != key], *[rows(name).alias(name) for name in children])


def _sortable(table: DataFrame, column: str) -> Column:
    """A text that sorts as the column does, nulls first: numbers with their sign and a fixed width, others as they are."""
    kind = dict(table.dtypes)[column]
    value = F.col(column)
    if kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
        number = value.cast("bigint")
        text = F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    elif kind in ("float", "double") or kind.startswith("decimal"):
        raise TypeError(f"{column}: order by whole numbers, texts or times")
    else:
        text = value.cast("string")
    return F.coalesce(F.concat(F.lit("1"), text), F.lit("0"))
