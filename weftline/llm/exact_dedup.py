"""Exact duplicates by sorting the content itself.

Sampled splitters range-partition the normalised texts, Spark's external sort orders each partition by the normalised bytes, so
that equal texts are neighbours, and one streaming pass compares neighbours in full. The splitters are made of a text's first
characters, its 64-bit hash and its id: whole texts as splitters would go through the driver, and the id spreads a text of very
many rows over several partitions. Such a text has the least or the greatest key of each of them; these few runs, two for each
partition, are settled afterwards by comparing their texts in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import LOWER, UPPER, Staged, ascii_lower, shuffle_width, table, trimmed

#: Characters of the normalised text that open a splitter.
HEAD = 64

_RUN_SCHEMA = "id long, part int, run long, n long, first_id long, last_id long, at_first boolean, at_last boolean, text_sha256 string, edge_text string"
_ARROW = pa.schema(
    [("id", pa.int64()), ("part", pa.int32()), ("run", pa.int64()), ("n", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())]
    + [("at_first", pa.bool_()), ("at_last", pa.bool_()), ("text_sha256", pa.string()), ("edge_text", pa.string())]
)


class _Edges:
    """Of runs in sorted order, those that may go on in another partition: the least and the greatest (head, hash).

    The sort is by text, so the runs of the first head come first and those of the last head last. Holds one run for
    each side (more only if different texts share head and hash).
    """

    def __init__(self):
        self.low: list = []
        self.high: list = []

    def add(self, key: tuple[str, int], run: tuple) -> None:
        if not self.low or key == self.low[0]:
            self.low = [key, *self.low[1:], run]
        elif key[0] == self.low[0][0] and key[1] < self.low[0][1]:
            self.low = [key, run]
        if self.high and key == self.high[0]:
            self.high.append(run)
        elif not self.high or key > self.high[0]:
            self.high = [key, run]

    def runs(self) -> list[tuple]:
        return list(dict.fromkeys(self.low[1:] + self.high[1:]))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one row each with its run's size and ends. Holds the ids of one run and one batch.

    At the end one more row, without an id, for each run at an edge: its size, ends and text.
    """
    part = TaskContext.get().partitionId()
    text: str | None = None
    digest, key = "", ("", 0)
    ids: list[pa.Array] = []
    edges = _Edges()
    run = 0

    def closed() -> pa.RecordBatch:
        every = pa.concat_arrays(ids)
        n = len(every)
        edges.add(key, (run, n, every[0].as_py(), every[-1].as_py(), text))
        where = np.arange(n)
        columns = [every, pa.repeat(pa.scalar(part, pa.int32()), n), pa.repeat(run, n), pa.repeat(n, n), pa.repeat(every[0], n), pa.repeat(every[-1], n)]
        columns += [pa.array(where == 0), pa.array(where == n - 1), pa.repeat(digest, n), pa.nulls(n, pa.string())]
        return pa.record_batch(columns, schema=_ARROW)

    for batch in batches:
        if not batch.num_rows:
            continue
        texts, found = batch["normal"].to_pylist(), batch["id"]
        bounds = [0, *_cuts(texts), len(texts)]
        out = []
        for a, b in zip(bounds, bounds[1:]):
            if ids and texts[a] != text:
                out.append(closed())
                ids, run = [], run + 1
            text, digest, key = texts[a], batch["digest"][a].as_py(), (batch["head"][a].as_py(), batch["hash"][a].as_py())
            ids.append(found.slice(a, b - a))
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if ids:
        yield closed()
        rows = [(None, part, number, n, a, z, None, None, None, t) for number, n, a, z, t in edges.runs()]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _cuts(texts: list[str]) -> list[int]:
    """Where neighbours differ, compared in full."""
    return [i for i, (a, b) in enumerate(zip(texts, texts[1:]), 1) if a != b]


def _sorted_by_content(rows: DataFrame, text: Column, id_name: str, last: bool, partitions: int | None) -> DataFrame:
    """``rows`` with normal, head and hash, partitioned by sampled splitters and sorted by the normalised bytes, then the id."""
    by_id = F.col(id_name).asc_nulls_first() if last else F.col(id_name).asc_nulls_last()
    n = partitions or shuffle_width(rows.sparkSession, rows)
    normal = ascii_lower(F.coalesce(text, F.lit("")))
    keyed = rows.withColumns({"head": F.substring(normal, 1, HEAD), "hash": F.xxhash64(normal)})
    # The normalised text is made after the exchange, which carries each text once.
    return keyed.repartitionByRange(n, F.col("head"), F.col("hash"), by_id).withColumn("normal", normal).sortWithinPartitions("normal", by_id)


def _check(keep: str) -> bool:
    if keep not in ("min", "max"):
        raise ValueError("keep: 'min' or 'max'")
    return keep == "max"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", partitions: int | None = None) -> DataFrame:
    """Group rows whose texts are equal after lower-casing A-Z.

    Returns one row for each input row: id, keep_id, group_size, kept, text_sha256 of the normalised text. ``keep``
    ("min" or "max") says which identifier of a group stays.

    Null texts count as empty, and all empty texts are one group. Null ids sort before all others and are a keep_id only
    if the group has no other. Of rows that repeat id and text, exactly one is kept; rows of one text and one id (many null ids,
    say) lie in one partition, as no key can part them. A text of any length is one row of the sort and is held whole beside
    its neighbour. Extra columns are ignored. An empty table gives an empty result.
    """
    last = _check(keep)
    spark = docs.sparkSession
    staged = Staged(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = _sorted_by_content(rows, F.col("text"), "id", last, partitions).select("id", "normal", "head", "hash", F.sha2("normal", 256).alias("digest"))
    runs = staged.put(ordered.mapInArrow(_runs, _RUN_SCHEMA), "runs")
    # At most two rows for each partition of the sort: small, whatever the input.
    edges = runs.where("edge_text IS NOT NULL").select("part", "run", "n", "first_id", "last_id", "edge_text")
    whole = edges.groupBy("edge_text").agg(
        F.sum("n").alias("all_n"),
        (F.max_by("last_id", "part") if last else F.min_by("first_id", "part")).alias("all_keep"),
        (F.max("part") if last else F.min("part")).alias("keeps"),
    )
    edges = edges.join(whole, "edge_text").select("part", "run", "all_n", "all_keep", (F.col("part") == F.col("keeps")).alias("holds"))
    end, flag = ("last_id", "at_last") if last else ("first_id", "at_first")
    return runs.where("edge_text IS NULL").drop("edge_text").join(edges, ["part", "run"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("all_n").isNotNull(), F.col("all_keep")).otherwise(F.col(end)).alias("keep_id"),
        F.coalesce("all_n", "n").alias("group_size"),
        (F.col(flag) & F.coalesce("holds", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", partitions: int | None = None) -> DataFrame:
    """The rows of ``docs``, all their columns, that ``exact_dedup`` keeps, by the same sort and neighbour comparison.

    Whole rows go through the sort once. Each partition gives out one row for each run; those at its edges are settled
    against other partitions' afterwards. Nulls, ties, repeated rows and empty tables: as in ``exact_dedup``.
    """
    last = _check(keep)
    staged = Staged(docs.sparkSession)
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]  # the caller's names can't clash with the keys
    schema = ", ".join(f"{n} {kind}" for n, (_, kind) in zip(inner, docs.dtypes)) + ", part int, run long, edge_text string"
    text, id_ = inner[names.index(text_col)], inner[names.index(id_col)]
    rows = docs.toDF(*inner)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, before, key, held, edges, like = TaskContext.get().partitionId(), 0, None, None, None, _Edges(), None

        def give() -> pa.RecordBatch:
            edges.add(key, (run, before))
            extra = [pa.array([part], pa.int32()), pa.array([run], pa.int64()), pa.nulls(1, pa.string())]
            return pa.record_batch([*held.columns, *extra], names=[*inner, "part", "run", "edge_text"])

        for batch in batches:
            if not batch.num_rows:
                continue
            texts, own = batch["normal"].to_pylist(), batch.select(inner)
            like = own.schema
            bounds = [0, *_cuts(texts), len(texts)]
            for a, b in zip(bounds, bounds[1:]):
                same = held is not None and texts[a] == before
                if held is not None and not same:
                    yield give()
                    run += 1
                if last or not same:
                    held = own.slice(b - 1 if last else a, 1)
                before, key = texts[a], (batch["head"][a].as_py(), batch["hash"][a].as_py())
        if held is not None:
            yield give()
            numbers, found = zip(*edges.runs())
            blank = [pa.nulls(len(numbers), f.type) for f in like]
            extra = [pa.array([part] * len(numbers), pa.int32()), pa.array(numbers, pa.int64()), pa.array(found, pa.string())]
            yield pa.record_batch([*blank, *extra], names=[*inner, "part", "run", "edge_text"])

    found = staged.put(_sorted_by_content(rows, F.col(text), id_, last, partitions).mapInArrow(trimmed(kept), schema), "kept")
    # The last (first) partition that a run at an edge reaches gives its row; two rows a partition at most.
    edges = found.where("edge_text IS NOT NULL").select("part", "run", "edge_text")
    best = F.max("part") if last else F.min("part")
    lost = edges.join(edges.groupBy("edge_text").agg(best.alias("wins")), "edge_text").where("part <> wins").select("part", "run")
    settled = found.where("edge_text IS NULL").join(lost, ["part", "run"], "left_anti")
    return settled.select(*[F.col(n).alias(name) for n, name in zip(inner, names)])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


OP10_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""
