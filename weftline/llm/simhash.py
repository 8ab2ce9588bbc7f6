"""SimHash near-duplicates with a table of distances to reference fingerprints.

1. One pass gives each text a 64-bit fingerprint; equal fingerprints are one node from then on.
2. The pivot table, written once for the distinct fingerprints, holds the Hamming distances of each quarter to the same
   quarter of the reference fingerprints. A reference's four distances add up to the distance from it as a whole.
3. Fingerprints within two bits leave at least two quarters alone, so they agree in all coordinates of those two: an equi-join
   on the coordinates of each pair of quarters finds every candidate. Buckets above a fixed size go to a finer key instead:
   all but two of sixteen 4-bit blocks, where a bucket can hold no more than 256 different fingerprints.
4. By the triangle inequality a pair whose distances to any reference differ by more than the limit can't be linked: the
   largest difference of coordinates discards it. Survivors are verified bit by bit.
5. The links' connected components are found by contraction.

For similar texts (``similar_texts``) the same table proposes pairs by the fingerprints of the texts' sets of shingles; the sets
decide, and an exact join completes what fingerprints can't find.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Staged, table
from weftline.llm.components import connect

SEED = 42
#: Reference fingerprints.
PIVOTS = [xxhash.xxh64_intdigest(f"pivot {i}", seed=SEED) for i in range(8)]
#: Bits of a quarter, and of a distance to a quarter (0 to 16) in a packed coordinate.
QUARTER, _WIDE = 16, 5
#: Fingerprints in a coarse bucket beyond which its members use the fine keys.
COARSE_LIMIT = 64
#: Shingles whose bits are counted at a time.
_CHUNK = 1 << 16


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included; one for all words if they are fewer, none without words.

    The text is UTF-8: A-Z are lowered, and words are split at ASCII white space.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())], np.uint64)


def simhash(h: np.ndarray) -> int:
    """Fingerprint of shingle hashes as a signed long: bits set in over half of them; 0 without any."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), _CHUNK):
        counts += np.unpackbits(h[k : k + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(h)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    return simhash(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(id, fp) for every row; a null text counts as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [fingerprint(t.as_py() or b"", shingle) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(each, "id long, fp long")


def _masks(block: int, free: int = 2) -> list[int]:
    """Masks that keep all but ``free`` of the blocks of ``block`` bits, as signed longs."""
    full = (1 << 64) - 1
    out = []
    for gone in combinations(range(64 // block), free):
        m = full
        for g in gone:
            m &= ~(((1 << block) - 1) << (g * block))
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """A row for each fingerprint and mask: the mask's number and the bits that it keeps."""
    keys = F.array(*[F.struct(F.lit(i).cast("short").alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("x"), F.lit(0).cast("long").alias("y")) for i, m in enumerate(masks)])
    return fps.select("*", F.inline(keys))


def pivot_table(fps: DataFrame) -> DataFrame:
    """fp, q0..q3 (the distances of a quarter to that of each reference, packed), d0.. (the distance to each reference)."""
    part = lambda v, q: F.shiftrightunsigned(v, q * QUARTER).bitwiseAND(F.lit((1 << QUARTER) - 1))
    near = [[F.bit_count(part(F.col("fp"), q).bitwiseXOR(F.lit(p >> (q * QUARTER) & ((1 << QUARTER) - 1)))) for p in PIVOTS] for q in range(64 // QUARTER)]
    packed = []
    for coordinates in near:
        value = F.lit(0).cast("long")
        for c in coordinates:
            value = F.shiftleft(value, _WIDE).bitwiseOR(c.cast("long"))
        packed.append(value)
    whole = [sum(near[q][j] for q in range(1, len(near))) + near[0][j] for j in range(len(PIVOTS))]
    return fps.select("fp", *[v.alias(f"q{q}") for q, v in enumerate(packed)], *[d.cast("byte").alias(f"d{j}") for j, d in enumerate(whole)])


def _pairs(keyed: DataFrame, distance: int) -> DataFrame:
    """Linked pairs within buckets: discarded by the largest difference of coordinates, then by the exact distance."""
    known = keyed.select("mask", "x", "y", "fp", *[f"d{j}" for j in range(len(PIVOTS))])
    a, b = known.alias("a"), known.alias("b")
    same = (F.col("a.mask") == F.col("b.mask")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.fp") < F.col("b.fp"))
    same &= F.greatest(*[F.abs(F.col(f"a.d{j}") - F.col(f"b.d{j}")) for j in range(len(PIVOTS))]) <= distance
    left = a.join(b, same).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    return left.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def links(fps: DataFrame, staged: Staged, distance: int = 2) -> DataFrame:
    """All pairs (a < b) of the distinct fingerprints ``fps`` (fp long) that differ in at most ``distance`` (<= 2) bits."""
    if not 0 <= distance <= 2:
        raise ValueError("distance: 0 to 2, as two quarters are left free")
    known = staged.put(pivot_table(fps), "pivots")
    pairs = F.array(*[F.struct(F.lit(4 * i + j).cast("short").alias("mask"), F.col(f"q{i}").alias("x"), F.col(f"q{j}").alias("y")) for i, j in combinations(range(4), 2)])
    keyed = known.select("*", F.inline(pairs))
    sizes = keyed.groupBy("mask", "x", "y").agg(F.count("*").alias("n")).where("n > 1")
    shared = staged.put(keyed.join(sizes, ["mask", "x", "y"]), "buckets")
    coarse = _pairs(shared.where(F.col("n") <= COARSE_LIMIT), distance)
    hot = shared.where(F.col("n") > COARSE_LIMIT).select("fp").distinct()
    fine = _keyed(hot.join(known, "fp"), _masks(4))
    sizes = fine.groupBy("mask", "x").agg(F.count("*").alias("n")).where("n > 1")
    fine = staged.put(fine.join(sizes, ["mask", "x"]).drop("n"), "fine")
    return staged.put(coarse.union(_pairs(fine, distance)).distinct(), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """Return id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links, for every row.

    Rows link if their fingerprints differ in at most ``distance`` bits. Null, empty and blank texts have fingerprint
    zero and link like any other. Repeated rows give repeated results. A component whose ids are all null has a null
    component_id. A text of any length is read whole by one task, which holds it and 20 times its size while it counts bits.
    Extra columns are ignored. An empty table gives an empty result.
    """
    staged = Staged(docs.sparkSession)
    rows = staged.put(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    least = staged.put(rows.groupBy("fp").agg(F.min("id").alias("least")), "least")
    roots = connect(links(least.select("fp"), staged, distance), staged)
    staged.drop("pivots", "buckets", "fine", "links")
    classes = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = classes.select("fp", "root").join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _proposed(classes: DataFrame, sets: DataFrame, staged: Staged, distance: int = 2) -> DataFrame:
    """(a, b) nodes of sets whose fingerprints the pivot table links: each with the first of its own fingerprint, and these firsts."""
    known = staged.put(classes.join(sets.select("node"), "node", "left_semi").select("fp", "node"), "printed")
    first = staged.put(known.groupBy("fp").agg(F.min("node").alias("first")), "firsts")
    met = links(first.select("fp"), staged, distance)
    left, right = first.select(F.col("fp").alias("a"), F.col("first").alias("x")), first.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    own = known.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return own.union(met.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(k1, k2, root, first_id) for every distinct text: texts of one root are linked by near copies.

    Two texts link if the Jaccard similarity of their sets of word shingles is at least ``similarity`` (0.5 or more, in
    hundredths). The pivot table of the sets' fingerprints proposes pairs by its equi-joins, and the sets decide. As similar
    sets may differ in more bits than such a table can find (about ten at 0.8, as many as unrelated texts do), the rest is
    completed by the exact join on prefixes (``jaccard_join``), which looks for links between the components found so far
    alone, so that no link is lost. ``k1`` and ``k2`` are the text's hash, ``first_id`` the smallest id of the rows that have
    it. Null, empty and blank texts have no shingles and are one group. A text of any length is held whole by one task, and
    with its shingles 30 times its size.
    """
    from weftline.llm.jaccard_join import linked, thinned  # that module takes its shingles from this one

    percent = round(similarity * 100)
    if not 50 <= percent <= 100:
        raise ValueError("similarity: 0.5 to 1")
    staged = Staged(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"))
    rows, classes, sets = thinned(own, shingle, percent, staged, prints=True)
    joined = linked(sets, percent, staged, _proposed(classes, sets, staged))
    rooted = classes.join(joined, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("root"))
    distinct = rows.groupBy("t1", "t2").agg(F.min("id").alias("first_id"), *[F.first(c).alias(c) for c in ("size", "k1", "k2")])
    out = distinct.join(rooted, ["k1", "k2"], "left")
    return out.select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), F.when(F.col("size") > 0, F.col("root")).otherwise(-1).alias("root"), "first_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all their columns, that stay when each group of ``similar_texts`` keeps the row of smallest id.

    Ties of id between different texts go to the smaller hash of the text; rows that repeat both id and text stay together.
    Null ids come after all others. Columns of any name are carried through. An empty table gives an empty result.
    """
    staged = Staged(docs.sparkSession)
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]  # the caller's names can't clash with the keys
    rows = docs.toDF(*inner)
    text_at, id_at = inner[names.index(text_col)], inner[names.index(id_col)]
    groups = staged.put(similar_texts(rows, id_at, text_at, shingle, similarity), "groups")
    order = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "k1", "k2")
    stays = groups.groupBy("root").agg(F.min(order).alias("m")).select("m.k1", "m.k2", "m.first_id")
    text = F.coalesce(F.col(text_at), F.lit(""))
    same = (F.xxhash64(text) == F.col("k1")) & (F.xxhash64(F.lit("second"), text) == F.col("k2")) & F.col(id_at).cast("long").eqNullSafe(F.col("first_id"))
    return rows.join(stays, same, "left_semi").select(*[F.col(n).alias(name) for n, name in zip(inner, names)])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
