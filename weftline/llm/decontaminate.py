"""Benchmark passages in documents, found by spaced-seed hashing.

Fixed masks read five of up to eight neighbouring words and ignore the rest, so that a hash survives substituted words at
the ignored places. The two masks together hit every stretch of twelve words with at most two substitutions, and every
stretch of eight with at most one. A fixed-size bit table of the benchmark's hashes lets each task skip positions that
match nothing; the rest meet the benchmark in an equi-join, and around every hit the aligned words are compared one by one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Staged, table, trimmed

#: Offsets that each mask reads.
MASKS = [(0, 1, 2, 4, 5), (0, 1, 4, 6, 7)]
SPAN = max(m[-1] for m in MASKS) + 1
#: Words of an aligned stretch that decide, and the share of them that must agree.
STRETCH, SIMILARITY = 12, 0.8
#: Bits of the table that tasks filter with: 2**26 is 8 MB, whatever the benchmark's size.
TABLE_BITS = 26
#: Distinct words that a task remembers.
REMEMBER = 200_000
_MARKS = ".,;:!?\"'()[]{}#$%&*|-_"
_FACTORS = [xxhash.xxh64_intdigest(f"place {i}") | 1 for i in range(SPAN)]


class Words:
    """Hashes of a text's words: lower case, marks at the ends cut, words of marks alone left out."""

    def __init__(self):
        self.known: dict[str, int | None] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = (text or "").lower().split()
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        for word in {*found}.difference(known):
            bare = word.strip(_MARKS)
            known[word] = xxhash.xxh64_intdigest(bare) if bare else None
        return np.array([h for h in map(known.__getitem__, found) if h is not None], np.uint64)


def seeds(words: np.ndarray, whole: tuple[int, ...] = ()) -> list[tuple[int, np.ndarray]]:
    """(length, hash at each position) by mask, then for each length in ``whole`` of the words in full."""
    out = []
    for number, offsets in enumerate([*MASKS, *(tuple(range(n)) for n in whole)]):
        n = len(words) - offsets[-1]
        if n <= 0:
            out.append((offsets[-1] + 1, np.empty(0, np.uint64)))
            continue
        h = np.full(n, xxhash.xxh64_intdigest(f"mask {offsets}"), np.uint64)
        for k, o in enumerate(offsets):
            h += words[o : o + n] * np.uint64(_FACTORS[k])
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        out.append((offsets[-1] + 1, h))
    return out


def _whole_lengths(n: int) -> tuple[int, ...]:
    """Items of fewer words than the masks' span must occur whole."""
    return (n,) if 0 < n < SPAN else ()


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << TABLE_BITS) - 1)
    return (h & low).astype(np.int64), ((h >> np.uint64(TABLE_BITS)) & low).astype(np.int64)


def _bench_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) to a row for each item and seed: item, its words' hashes in the first row only, key, place, length."""
    words = Words()
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = words(text)
            if not len(w):
                continue
            hashes, first = w.view(np.int64).tolist(), True
            for n, h in seeds(w, _whole_lengths(len(w))) if len(w) >= SPAN else seeds(w, _whole_lengths(len(w)))[len(MASKS) :]:
                for place, key in enumerate(h.view(np.int64).tolist()):
                    rows.append((item, hashes if first else None, len(w), key, place))
                    first = False
        if rows:
            item, hashes, size, key, place = zip(*rows)
            yield pa.record_batch(
                [pa.array(item, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(size, pa.int32()), pa.array(key, pa.int64()), pa.array(place, pa.int32())],
                names=["item", "words", "size", "key", "place"],
            )


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's keys as one compressed bit table."""
    bits = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    for batch in batches:
        for places in _places(batch.column(0).to_numpy().view(np.uint64)):
            np.bitwise_or.at(bits, places >> 3, np.left_shift(1, places & 7).astype(np.uint8))
    yield pa.record_batch([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["bits"])


def _clusters(batches: Iterator[pa.RecordBatch], bits: np.ndarray, whole: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """(id, text) to stretches around positions that may match: row, id, start, words, hits (key, place)."""
    part, row, words = TaskContext.get().partitionId(), 0, Words()
    margin = STRETCH - 1
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("start", pa.int32()), ("words", pa.list_(pa.int64())), ("hits", pa.list_(pa.struct([("key", pa.int64()), ("place", pa.int32())])))])
    for batch in batches:
        out = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            row += 1
            w = words(text.as_py())
            keys, places = [], []
            for _, h in seeds(w, whole):
                a, b = _places(h)
                at = np.flatnonzero((bits[a >> 3] >> (a & 7).astype(np.uint8)) & 1)
                at = at[((bits[b[at] >> 3] >> (b[at] & 7).astype(np.uint8)) & 1) > 0]
                keys.append(h[at])
                places.append(at)
            place = np.concatenate(places)
            if not len(place):
                continue
            order = np.argsort(place, kind="stable")
            place, key = place[order], np.concatenate(keys)[order].view(np.int64)
            cuts = np.flatnonzero(np.diff(place) > 2 * margin) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)]):
                start = max(0, int(place[lo]) - margin)
                here = w[start : int(place[hi - 1]) + SPAN + margin]
                out.append(((part << 40) + row, doc, start, here.view(np.int64), [{"key": k, "place": p} for k, p in zip(key[lo:hi].tolist(), place[lo:hi].tolist())]))
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def _needed(n: int) -> int:
    """Words that must agree in a stretch of n; what the masks are sure to hit."""
    return n if n < SPAN else max(int(np.ceil(SIMILARITY * n)), n - 1 if n < STRETCH else 0)


def stretch_match(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, float] | None:
    """Compare ``doc`` with ``item`` laid ``shift`` words into it.

    (agreeing words, aligned words, best share of agreement over a stretch), or None if no stretch reaches SIMILARITY.
    """
    lo, hi = max(0, shift), min(len(doc), shift + len(item))
    n = min(STRETCH, len(item))
    if hi - lo < n:
        return None
    same = doc[lo:hi] == item[lo - shift : hi - shift]
    total = np.concatenate(([0], np.cumsum(same)))
    best = int((total[n:] - total[:-n]).max())
    if best < _needed(n):
        return None
    # From the first to the last word of stretches that reach it.
    good = np.flatnonzero(total[n:] - total[:-n] >= _needed(n))
    a, b = int(good[0]), int(good[-1]) + n
    return int(total[b] - total[a]), b - a, best / n


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for id_, item, shift, doc, words in zip(batch["id"].to_pylist(), batch["item"].to_pylist(), batch["shift"].to_pylist(), batch["words"], batch["item_words"]):
            found = stretch_match(doc.values.to_numpy(), words.values.to_numpy(), shift)
            if found:
                out.append((id_, item, *found))
        if out:
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["id", "item", "matched", "aligned", "similarity"])


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item that share an aligned stretch of words.

    They do if, with words aligned one to one, some STRETCH neighbouring words (or the whole item, if shorter) agree in at
    least SIMILARITY of their places: ten of twelve. Returns id, item, matched_words and aligned_words of the longest such
    overlap, and similarity, the best stretch's share. Words are compared in lower case without marks at their ends.

    Items of 1 to 7 words must occur in full, those without words (null and empty ones, too) never match; in items of 8 to 11
    words one word may differ. Null or empty documents match nothing. Repeated ids are judged together, null ids are
    one group. A text of any length is held whole by one task, with its words' hashes; what is shuffled of it are the words around
    hits. Extra columns are ignored. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    staged = Staged(spark)
    bench = staged.put(
        benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).mapInArrow(
            _bench_rows, "item long, words array<long>, size int, key long, place int"
        ),
        "bench",
    )
    whole = tuple(sorted(r[0] for r in bench.where(F.col("size") < SPAN).select("size").distinct().collect()))  # 1 to 7 at most
    bits = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    for r in bench.select("key").mapInArrow(_bits, "bits binary").toLocalIterator():
        bits |= np.frombuffer(zlib.decompress(r[0]), np.uint8)
    packed = spark.sparkContext.broadcast(zlib.compress(bits.tobytes(), 1))

    def clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _clusters(batches, np.frombuffer(zlib.decompress(packed.value), np.uint8), whole)

    near = staged.put(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
            trimmed(clusters), "row long, id long, start int, words array<long>, hits array<struct<key:long,place:int>>"
        ),
        "clusters",
    )
    hits = near.select("row", "start", F.inline("hits"))
    keys = bench.select("key", "item", F.col("place").alias("item_place"))
    laid = hits.join(keys, "key").select("row", "start", "item", (F.col("place") - F.col("start") - F.col("item_place")).alias("shift")).distinct()
    items = bench.where("words IS NOT NULL").select("item", F.col("words").alias("item_words"))
    pairs = laid.join(near.select("row", "start", "id", "words"), ["row", "start"]).join(items, "item")
    found = pairs.select("id", "item", "shift", "words", "item_words").mapInArrow(_verified, "id long, item long, matched int, aligned int, similarity double")
    best = found.groupBy("id", "item").agg(F.max(F.struct("matched", "aligned")).alias("m"), F.max("similarity").alias("similarity"))
    return best.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("m.matched").alias("matched_words"), F.col("m.aligned").alias("aligned_words"), "similarity"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, whose text overlaps no benchmark item.

    Rows are judged one by one (each has a number of its own, written with the table), so repeated or null ids and clashing
    column names don't matter. A text of any length is held whole by one task. The rest is as in ``overlaps``.
    """
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    rows = Staged(docs.sparkSession).put(docs.toDF(*inner).withColumn("row", F.monotonically_increasing_id()), "numbered")
    asked = rows.select("row", F.col(inner[names.index(text_col)]).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    bad = overlaps(asked, items, "row", "text", "item", "text").select("row").distinct()
    return rows.join(bad, "row", "left_anti").select(*[F.col(n).alias(name) for n, name in zip(inner, names)])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
