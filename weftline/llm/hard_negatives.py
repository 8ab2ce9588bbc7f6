"""Hard negatives by exact inner-product search over one-dimensional distance keys.

1. Vectors get one more component, the root of (M^2 - |x|^2) with M the largest norm, so that all have length M and the score
   with an anchor (whose further component is 0) falls as the distance grows: d^2 = |a|^2 + M^2 - 2 score.
2. Pivots are fitted on a bounded sample; every vector belongs to its nearest one. The index is stored sorted by
   (pivot, distance), in blocks of rows within a ring of distances, and has every row.
3. A vector within r of an anchor has a distance to its pivot within r of the anchor's. So a search scans, in each pivot, the
   interval of keys around the anchor's, and widens it until the best k found are nearer than what is left can be. Where
   only scores up to a bound are asked for, rings that are wholly nearer are left out, too.
4. Anchors go in packs of neighbours; a pack meets each block that it asks for once, by an equi-join, and is scored by one
   matrix product. Components are whole numbers, so scores are exact.
"""

from __future__ import annotations

import contextlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import Staged, shuffle_width, table

#: Pivots, rows of the sample that they are fitted on (it also sets the rings' width), and rings of a pivot at most.
PIVOTS, SAMPLE, RINGS = 16, 4096, 256
#: Rows of a block and anchors of a pack at most; packs whose best rows a task holds at a time.
BLOCK, PACK, HELD = 2048, 64, 256
_HIGH, _LOW = (1 << 63) - 1, -(1 << 63)
#: Sums of products up to this are exact in double precision.
_EXACT = 1 << 53


@contextlib.contextmanager
def _small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of few rows while a table of large rows is written."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Space:
    """What tasks need to place a vector: number of components, M^2, pivots (with the further component), width of a ring."""

    def __init__(self, size: int, largest: int, widest: int, sample: np.ndarray):
        self.size, self.m2 = size, largest
        self.dtype = "<i2" if widest < 1 << 15 else "<i4" if widest < 1 << 31 else "<i8"
        points = self.augmented(sample)
        self.pivots = _centres(points)
        near = self.distances(points).min(axis=1)
        spread = np.subtract(*np.quantile(near, [0.95, 0.05])) if len(near) else 0
        self.reach = 2 * np.sqrt(float(largest)) + 1
        self.width = max(spread / 8, self.reach / (RINGS - 1))

    def augmented(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(0, self.m2 - np.einsum("ij,ij->i", x.astype(float), x.astype(float)))
        return np.hstack([x.astype(float), np.sqrt(rest)[:, None]])

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x.astype(float), np.zeros((len(x), 1))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        square = (points**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(0, square))

    def slack(self) -> float:
        """More than rounding can change a distance of square roots."""
        return 1e-6 * self.reach

    def matrix(self, data: bytes | list[bytes]) -> np.ndarray:
        return np.frombuffer(data if isinstance(data, bytes) else b"".join(data), self.dtype).reshape(-1, self.size or 1)[:, : self.size]

    def padded(self, vectors: pa.Array) -> np.ndarray:
        """Rows of whole numbers; components that shorter vectors lack are 0."""
        lengths = np.diff(vectors.offsets.to_numpy())
        out = np.zeros((len(vectors), max(1, self.size)), self.dtype)
        out[np.arange(out.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy()
        return out

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.m2 < _EXACT:
            return (a.astype(float) @ b.astype(float).T).astype(np.int64)
        return (a.astype(object) @ b.astype(object).T).astype(np.int64)  # beyond a long this raises


def _centres(points: np.ndarray, rounds: int = 5) -> np.ndarray:
    """At most PIVOTS centres of the sample: far ones first, then a few rounds of means."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    chosen = [0]
    nearest = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < PIVOTS and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    centres = points[chosen]
    for _ in range(rounds):
        to = ((points[:, None, :] - centres) ** 2).sum(axis=2).argmin(axis=1) if len(points) <= 512 else (-2 * points @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
        centres = np.array([points[to == k].mean(axis=0) if (to == k).any() else centres[k] for k in range(len(centres))])
    return centres


def _placed(space: Space) -> Callable:
    """(rid, id, label, v) to (pivot, ring, dist, rid, id, label, vec)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = space.padded(batch["v"])
            far = space.distances(space.augmented(x))
            pivot = far.argmin(axis=1)
            dist = far[np.arange(len(x)), pivot]
            columns = [pa.array(pivot, pa.int32()), pa.array(np.floor(dist / space.width), pa.int32()), pa.array(dist), batch["rid"], batch["id"], batch["label"]]
            yield pa.record_batch([*columns, pa.array([r.tobytes() for r in x], pa.binary())], names=["pivot", "ring", "dist", "rid", "id", "label", "vec"])

    return place


_PACKED = "part long, pivot int, ring int, rids array<long>, ids array<long>, labels array<long>, vecs binary"


def _packs(most: int, by_ring: bool) -> Callable:
    """Sorted placed rows to rows of at most ``most`` of them, of one pivot (and ring). ``part`` numbers the rows made."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        now = None

        def give() -> pa.RecordBatch:
            nonlocal number
            rows = pa.Table.from_batches(held)
            number += 1
            lists = [pa.array([rows[c].to_numpy()], pa.list_(pa.int64())) for c in ("rid", "id", "label")]
            one = [pa.array([number]), pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), *lists, pa.array([b"".join(rows["vec"].to_pylist())], pa.binary())]
            held.clear()
            return pa.record_batch(one, names=["part", "pivot", "ring", "rids", "ids", "labels", "vecs"])

        for batch in batches:
            pivots, rings = batch["pivot"].to_numpy(), batch["ring"].to_numpy() if by_ring else np.zeros(batch.num_rows, int)
            edges = np.flatnonzero((np.diff(pivots) != 0) | (np.diff(rings) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                while a < b:
                    key = (int(pivots[a]), int(rings[a]))
                    size = sum(h.num_rows for h in held)
                    if held and (key != now or size == most):
                        yield give()
                        size = 0
                    now = key
                    step = min(b - a, most - size)
                    held.append(batch.slice(a, step))
                    a += step
        if held:
            yield give()

    return pack


def _stored(placed: DataFrame, most: int, by_ring: bool) -> DataFrame:
    n = shuffle_width(placed.sparkSession)
    order = ["pivot", "dist", "rid"]
    return placed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_packs(most, by_ring), _PACKED)


def _rings(space: Space, vectors: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Whether a ring of a pivot may hold vectors at a distance from ``inner`` to ``outer`` of any of the anchors."""
    to_pivot = space.distances(space.queries(vectors))[:, :, None]
    low = np.arange(RINGS + 2) * space.width
    s = space.slack()
    may = (low <= to_pivot + outer[:, None, None] + s) & (low + space.width >= np.maximum(to_pivot - outer[:, None, None], inner[:, None, None] - to_pivot) - s)
    return (may & (outer >= 0)[:, None, None]).any(axis=0)


def _asked(space: Space) -> Callable:
    """Packs to (part, pivot, ring) of the rings that they ask for in this round and haven't seen."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, inner = space.matrix(row["vecs"]), np.array(row["inner"])
                wanted = _rings(space, x, inner, np.array(row["next"])) & ~_rings(space, x, inner, np.array(row["seen"]))
                pivots, rings = np.nonzero(wanted)
                n = len(pivots)
                yield pa.record_batch([pa.repeat(pa.scalar(row["part"], pa.int64()), n), pa.array(pivots, pa.int32()), pa.array(rings, pa.int32())], names=["part", "pivot", "ring"])

    return ask


class _Best:
    """The best k rows so far of each anchor of a pack and each of its bands of scores."""

    def __init__(self, anchors: int, highs: list, lows: list, k: int):
        self.k, bands = k, max(map(len, highs), default=0)
        self.high, self.low = np.full((bands, anchors), _LOW), np.full((bands, anchors), _HIGH)
        for q, (h, l) in enumerate(zip(highs, lows)):
            self.high[: len(h), q], self.low[: len(l), q] = h, l
        self.found = [(np.empty(0, np.int64),) * 3 for _ in range(bands)]  # anchor, score, id
        self.worst, self.worst_id = np.full((bands, anchors), _LOW), np.full((bands, anchors), _HIGH)

    def add(self, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        for b, (q0, s0, i0) in enumerate(self.found):
            w = self.worst[b][:, None]
            better = (scores > w) | ((scores == w) & (ids < self.worst_id[b][:, None]))
            q, at = np.nonzero(fits & better & (scores <= self.high[b][:, None]) & (scores >= self.low[b][:, None]))
            if not len(q):
                continue
            q, s, i = np.concatenate([q0, q]), np.concatenate([s0, scores[q, at]]), np.concatenate([i0, ids[at]])
            order = np.lexsort((i, -s, q))
            q, s, i = q[order], s[order], i[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            keep = rank < self.k
            self.found[b] = (q[keep], s[keep], i[keep])
            last = rank == self.k - 1
            self.worst[b, q[last]], self.worst_id[b, q[last]] = s[last], i[last]

    def rows(self, part: int) -> pa.RecordBatch:
        q, s, i = (np.concatenate([f[j] for f in self.found]) if self.found else np.empty(0, np.int64) for j in range(3))
        band = np.repeat(np.arange(len(self.found)), [len(f[0]) for f in self.found])
        columns = [np.full(len(q), part), q, band, s, i]
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["part", "q", "band", "score", "id"])


def _scanned(space: Space, k: int, same: bool) -> Callable:
    """Rows of a pack beside a block to the pack's best of what the task has seen. Holds the best rows of HELD packs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, _Best] = OrderedDict()
        for batch in batches:
            for row in batch.to_pylist():
                part = row["part"]
                best = held.pop(part, None) or _Best(len(row["rids"]), row["high"], row["low"], k)
                held[part] = best
                scores = space.score(space.matrix(row["vecs"]), space.matrix(row["b_vecs"]))
                ids, rids = np.array(row["b_ids"]), np.array(row["b_rids"])
                alike = np.array(row["labels"])[:, None] == np.array(row["b_labels"])
                best.add(scores, ids, (alike & (np.array(row["rids"])[:, None] != rids)) if same else ~alike)
                if len(held) > HELD:
                    oldest, given = held.popitem(last=False)
                    yield given.rows(oldest)
        for part, best in held.items():
            yield best.rows(part)

    return scan


def _advanced(space: Space, k: int) -> Callable:
    """Packs with what they have found to packs with the next radius of each anchor; an anchor that is sure keeps its own.

    With k rows in each band nothing beyond the farthest of them matters; with fewer the band's own bound does. Until
    the rows are there the radius doubles.
    """

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.to_pylist()
            for row in out:
                x = space.matrix(row["vecs"]).astype(float)
                square = (x**2).sum(axis=1) + float(space.m2)
                got = {(g["q"], g["band"]): g for g in row.pop("got") or []}
                seen = np.array(row["next"])
                after = seen.copy()
                for q, lows in enumerate(row["low"]):
                    far, full = -1.0, True
                    for band, low in enumerate(lows):
                        g = got.get((q, band))
                        enough = g is not None and g["n"] >= k
                        bound = g["worst"] if enough else low
                        full &= enough
                        far = max(far, space.reach if bound == _LOW else min(space.reach, float(np.sqrt(max(0.0, square[q] - 2.0 * bound)))))
                    if far > seen[q]:
                        step = max(seen[q] - row["inner"][q], space.width)
                        after[q] = far if full else min(far, seen[q] + step)
                row["seen"], row["next"] = seen.tolist(), after.tolist()
                row["active"] = bool((after > seen).any())
            yield pa.RecordBatch.from_pylist(out, schema=_schema())

    return advance


def _schema() -> pa.Schema:
    numbers, reals, nested = pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.list_(pa.int64()))
    return pa.schema(
        [("part", pa.int64()), ("rids", numbers), ("ids", numbers), ("labels", numbers), ("vecs", pa.binary())]
        + [("high", nested), ("low", nested), ("inner", reals), ("seen", reals), ("next", reals), ("active", pa.bool_())]
    )


_STATE = "part long, rids array<long>, ids array<long>, labels array<long>, vecs binary, high array<array<long>>, low array<array<long>>, inner array<double>, seen array<double>, next array<double>, active boolean"


def _begun(space: Space, bands: Callable[[dict], tuple[list, list]]) -> Callable:
    """Packs to their first state: bands of scores, and a first radius of half the way to the nearest pivot."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                high, low = bands(row)
                x = space.matrix(row["vecs"])
                square = (x.astype(float) ** 2).sum(axis=1) + float(space.m2)
                start = space.distances(space.queries(x)).min(axis=1) / 2
                top = [max(h, default=None) for h in high]
                inner = np.array([0.0 if t is None or t == _HIGH else np.sqrt(max(0.0, s - 2.0 * t)) for t, s in zip(top, square)])
                row |= {"high": high, "low": low, "inner": inner.tolist(), "seen": [-1.0] * len(x), "active": True}
                row["next"] = [-1.0 if t is None else float(i + s) for t, i, s in zip(top, inner, start)]
                out.append({f: row[f] for f in _schema().names})
            yield pa.RecordBatch.from_pylist(out, schema=_schema())

    return begin


def _search(packs: DataFrame, blocks: DataFrame, space: Space, k: int, same: bool, staged: Staged, name: str) -> DataFrame:
    """(part, q, band, score, id, rank): the best k rows of every band of every anchor, certified."""
    spark = packs.sparkSession
    where_ = blocks.select("pivot", "ring", F.col("part").alias("block"))
    held = blocks.select(F.col("part").alias("block"), *[F.col(c).alias(f"b_{c}") for c in ("rids", "ids", "labels", "vecs")])
    top = Window.partitionBy("part", "q", "band").orderBy(F.desc("score"), "id")
    best, turn = None, 0
    while True:
        asked = packs.where("active").select("part", "vecs", "inner", "seen", "next").mapInArrow(_asked(space), "part long, pivot int, ring int")
        pairs = staged.put(asked.join(where_, ["pivot", "ring"]).select("part", "block"), f"{name}-pairs{turn}")
        beside = pairs.join(packs.select("part", "rids", "labels", "vecs", "high", "low"), "part").join(held, "block")
        with _small_batches(spark, 32):
            new = staged.put(beside.mapInArrow(_scanned(space, k, same), "part long, q long, band long, score long, id long"), f"{name}-new{turn}")
        every = new if best is None else best.drop("rank").unionByName(new)
        best = staged.put(every.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k), f"{name}-best{turn}")
        got = best.groupBy("part", "q", "band").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
        got = got.groupBy("part").agg(F.collect_list(F.struct("q", "band", "n", "worst")).alias("got"))  # a pack's anchors and bands: few
        with _small_batches(spark, 256):
            packs = staged.put(packs.join(got, "part", "left").mapInArrow(_advanced(space, k), _STATE), f"{name}-packs{turn}")
        staged.drop(f"{name}-pairs{turn}", f"{name}-new{turn}", f"{name}-best{turn - 1}", f"{name}-packs{turn - 1}")
        if packs.where("active").isEmpty():
            return best
        turn += 1


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """For each anchor and each of its best positives the best rows of other labels in a band of scores under the positive's.

    ``rows``: id long, label, vector array of whole numbers (long); ``anchor`` is a condition over these. A row's score is its
    inner product with the anchor; higher ones come first, ties by smaller id. An anchor's positives are its first other rows
    of the same label. Negatives have a score from ``percent`` hundredths of the positive's to the positive's itself, so a
    negative positive score has none. Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id, label or vector, or a null component, take no part. Vectors of unlike length are compared over the
    components that both have (the rest counts as 0). Rows that repeat an id, or a whole row, are rows of their own: each is
    an anchor, and each is another row to the others. Scores must fit a long, else the job fails. Extra columns are ignored.
    An empty table gives an empty result.
    """
    spark = rows.sparkSession
    staged = Staged(spark)
    fine = "id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL)"
    known = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor")).where(fine)
    known = staged.put(known.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    square = F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x.cast("decimal(19,0)") * x.cast("decimal(19,0)")).cast("decimal(38,0)"))
    one = known.agg(F.max(F.size("v")).alias("size"), F.max(square).alias("largest"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("widest")).first()
    sample = known.orderBy(F.xxhash64("rid")).limit(SAMPLE).select("v").collect()
    size = one["size"] or 0
    points = np.zeros((len(sample), max(1, size)))
    for at, r in enumerate(sample):
        points[at, : len(r["v"])] = r["v"]
    space = Space(max(1, size), int(one["largest"] or 0), int(one["widest"] or 0), points)

    schema = "pivot int, ring int, dist double, rid long, id long, label long, vec binary"
    place = lambda some: some.select("rid", "id", "label", "v").mapInArrow(_placed(space), schema)
    blocks = staged.put(_stored(staged.put(place(known), "placed"), BLOCK, True), "blocks")
    packs = staged.put(_stored(place(known.where("anchor")), PACK, False).drop("pivot", "ring"), "anchors")

    every = lambda row: ([[_HIGH]] * len(row["rids"]), [[_LOW]] * len(row["rids"]))
    with _small_batches(spark, 256):
        begun = staged.put(packs.mapInArrow(_begun(space, every), _STATE), "begun")
    near = _search(begun, blocks, space, positives, True, staged, "positives")

    scores = near.groupBy("part", "q").agg(F.collect_list(F.struct("rank", "score")).alias("found"))  # k of an anchor
    per_pack = scores.groupBy("part").agg(F.collect_list(F.struct("q", "found")).alias("found"))

    def below(row: dict) -> tuple[list, list]:
        """A band for each positive in order; one of a negative score holds nothing."""
        high, low = [[] for _ in row["rids"]], [[] for _ in row["rids"]]
        for f in row["found"] or []:
            for g in sorted(f["found"], key=lambda g: g["rank"]):
                s = g["score"]
                high[f["q"]].append(s)
                low[f["q"]].append(-((-percent * s) // 100) if s >= 0 else s + 1)
        return high, low

    with _small_batches(spark, 256):
        begun = staged.put(packs.join(per_pack, "part", "left").mapInArrow(_begun(space, below), _STATE), "bands")
    hard = _search(begun, blocks, space, negatives, False, staged, "negatives")

    names = packs.select("part", F.posexplode("ids").alias("q", "anchor_id"))
    pos = near.select("part", "q", (F.col("rank") - 1).cast("long").alias("band"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    neg = hard.select("part", "q", "band", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    found = pos.join(neg, ["part", "q", "band"]).join(names.withColumn("q", F.col("q").cast("long")), ["part", "q"])
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    rows = rows.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").alias("id"), label.alias("label"), whole.alias("vector"))
    return hard_negatives(rows, F.col("id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(CAST(e AS DOUBLE) * 256) for e in embedding] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([e for e in embedding if e IS NULL OR NOT isfinite(e)]) = 0),
s AS (
  SELECT a.rid AS arid, a.id AS anchor_id, b.rid, b.id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.rid <> b.rid WHERE a.id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.arid = p.arid AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.arid, p.rid ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 5
"""
