"""Jaccard join over word shingles with adaptive multi-match prefixes.

Order the shingles of all texts in one way. Two sets that share t shingles share at least l of them within their first
size - t + l ones, for any l up to t: the l-prefix. A longer prefix meets more often, but asks for more meetings before a pair
is verified. The join uses this twice.

1. Thinning, by the order of the shingles' hashes: l is a tenth of a set's size. A text of whose prefix fewer shingles occur in
   another prefix than any partner would share can't link; most texts go here, for a shuffle of three tenths of the shingles.
2. The texts left are ordered by document frequency, rarest first. Shingles of one text alone only take up room at the front of
   its prefix: a text with too few others can't link at all. Each text chooses the l of least estimated cost, by the frequencies
   in its l-prefix: the meetings it causes, and the verifications of those that can meet l times. A pair needs the smaller l of
   its two texts, counted within that prefix of both.
3. Only components are asked for. So each shingle first proposes its texts to one text that shares most (few shingles of its
   own); then components are contracted, and shingles join texts of different components alone, until every pair that meets
   often enough is verified. No link between components is lost; those within one change nothing.

A shingle is stood for by its XXH64 (64 bits, seeded), a set by 128 bits of its sorted hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import LOWER, UPPER, Staged, pieces, shuffle_width, table, trimmed
from weftline.llm.components import connect
from weftline.llm.simhash import shingle_hashes, simhash

#: Largest l that a text may choose in the join.
LEVELS = 8
#: Hundredths of a set's size that l is when texts are thinned out.
THIN = 10
#: Cost of verifying a pair for each of a text's shingles, in meetings of a shingle.
VERIFY = 0.05
#: Shingles before one in a text's prefix by which a pair is known to have met already.
BEFORE = 16
#: Bits of the table that says which texts are read again (8 MB, whatever the input).
BITS = 1 << 26


def _ceil(of: Column, percent: int) -> Column:
    return F.ceil(of * percent / 100.0 - 1e-9).cast("long")


def _least(size: int, percent: int) -> int:
    """Shingles that a set of this size shares with any it links to: at least ``percent`` hundredths of its size."""
    return -(-size * percent // 100)


def _thin_prefix(size: int, percent: int) -> tuple[int, int]:
    """(length of the prefix, shared shingles that a link needs) of the first step; a partner may be smaller by ``percent``."""
    level = lambda n: max(1, -(-n * THIN // 100))
    return min(size, size - _least(size, percent) + level(size)), min(level(_least(size, percent)), _least(size, percent))


def _signed(shingle: int, percent: int, extra: list[str], prints: bool):
    """(id, text, extra) to (id, size, k1, k2, need, fp, prefix, extra). A task gives the prefix of a text that it sees again only once."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[int, int]] = set()
        for batch in batches:
            for part in pieces(batch):
                rows = []
                for text in part["text"].cast(pa.binary()):
                    h = np.unique(shingle_hashes(text.as_py(), shingle))
                    digest = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
                    key = (int(digest[0]), int(digest[1]))
                    length, need = _thin_prefix(len(h), percent)
                    rows.append((len(h), *key, need, simhash(h) if prints else 0, np.empty(0, np.int64) if key in known else h[:length].view(np.int64)))
                    if len(known) < 1 << 20:
                        known.add(key)
                columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:5]] + [pa.array([r[5] for r in rows], pa.list_(pa.int64()))]
                names = ["id", "size", "k1", "k2", "need", "fp", "prefix", *extra]
                yield pa.record_batch([part["id"], *columns, *[part[c] for c in extra]], names=names)

    return sign


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, k1) to (k1, n): how many of its tokens another text has, too.

    Rows at a batch's edge count, as the other side isn't seen: this can only keep a text too many.
    """
    for batch in batches:
        token, k1 = batch["token"].to_numpy(), batch["k1"].to_numpy()
        first = np.ones(len(token), bool)
        first[1:] = (np.diff(token) != 0) | (np.diff(k1) != 0)
        token, k1 = token[first], k1[first]
        if not len(token):
            continue
        equal = token[1:] == token[:-1]
        met = np.ones(len(token), bool)
        met[1:-1] = equal[:-1] | equal[1:]
        found, n = np.unique(k1[met], return_counts=True)
        yield pa.record_batch([pa.array(found), pa.array(n.astype(np.int64))], names=["k1", "n"])


def _bit(of: Column) -> Column:
    return F.xxhash64(of).bitwiseAND(F.lit(BITS - 1))


def _bit_table(ids: DataFrame) -> bytes:
    """A table of BITS bits with those of the ids set, made on the executors; its size doesn't depend on the input."""
    bit = ids.select(_bit(F.col("id")).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 31 AS INT)))").alias("set"))
    out = np.zeros(BITS >> 5, np.uint32)
    rows = words.toArrow()
    out[rows["word"].to_numpy()] = rows["set"].to_numpy().astype(np.uint32)
    return out.tobytes()


def thinned(docs: DataFrame, shingle: int, percent: int, staged: Staged, prints: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, sets): id, size, k1, k2 and further long columns of every row; the distinct sets with a node, their
    smallest id and with ``prints`` their fingerprint; and (node, size, hashes) of those that share enough of their prefix with
    others to be able to link."""
    spark = docs.sparkSession
    extra = [c for c in docs.columns if c not in ("id", "text")]
    schema = ", ".join(f"{c} long" for c in ("id", "size", "k1", "k2", "need", "fp")) + ", prefix array<long>" + "".join(f", {c} long" for c in extra)
    signed = staged.put(docs.mapInArrow(trimmed(_signed(shingle, percent, extra, prints)), schema), "signed")
    rows = staged.put(signed.select("id", "size", "k1", "k2", *extra), "rows")
    classes = signed.where("size > 0").groupBy("k1", "k2").agg(F.min("id").alias("first_id"), *[F.first(c).alias(c) for c in ("size", "need", "fp")])
    classes = staged.put(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    tokens = signed.select("k1", F.explode("prefix").alias("token"))
    placed = tokens.repartitionByRange(shuffle_width(spark, tokens), "token", "k1").sortWithinPartitions("token", "k1")
    met = staged.put(placed.mapInArrow(trimmed(_met), "k1 long, n long").groupBy("k1").agg(F.sum("n").alias("n")), "met")
    staged.drop("signed")
    left = staged.put(classes.join(met, "k1").where("n >= need").select("k1", "k2", "node", "size", "first_id"), "left")

    bits = spark.sparkContext.broadcast(_bit_table(left.select(F.col("first_id").alias("id"))))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.frombuffer(bits.value, np.uint32)
        for batch in batches:
            bit = batch["bit"].to_numpy()
            for part in pieces(batch.filter(pa.array((asked[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1))):
                found = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in part["text"].cast(pa.binary())]
                keys = [np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64) for h in found]
                columns = [pa.array([int(k[j]) for k in keys], pa.int64()) for j in (0, 1)]
                yield pa.record_batch([*columns, pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], names=["k1", "k2", "hashes"])

    whole = docs.select("text", _bit(F.col("id")).alias("bit")).mapInArrow(trimmed(again), "k1 long, k2 long, hashes array<long>")
    sets = whole.join(left.select("k1", "k2", "node", "size"), ["k1", "k2"]).dropDuplicates(["node"])
    return rows, classes, staged.put(sets.select("node", "size", "hashes"), "sets")


def _levels(percent: int):
    """(node, size, ranked) to (node, size, shared, level, tokens): the l of least cost, and the tokens of its prefix with the
    smallest l whose prefix holds them and their place among the set's shared shingles."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, size, dfs, tokens in zip(*(batch[c].to_pylist() for c in ("node", "size", "dfs", "tokens"))):
                base = len(tokens) - _least(size, percent) + 1  # shingles of one text alone stand before all others
                meetings = np.cumsum(np.array(dfs, float) - 1)
                costs = []
                for level in range(1, min(LEVELS, _least(size, percent)) + 1):
                    met = meetings[min(len(tokens), base + level - 1) - 1]
                    costs.append(met + met / level * size * VERIFY)
                level = int(np.argmin(costs)) + 1
                n = min(len(tokens), base + level - 1)
                rows.append((node, size, len(tokens), level, [{"token": t, "from": max(1, i - base + 2), "at": i} for i, t in enumerate(tokens[:n])]))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.struct([("token", pa.int64()), ("from", pa.int64()), ("at", pa.int64())]))]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=["node", "size", "shared", "level", "tokens"])

    return choose


def _can_link(a: str, b: str, percent: int) -> Column:
    """By sizes, and by how many shingles of each are left from one that both have, if it is the first that they share.

    A pair that can link passes at its first shared shingle, so it may fail at others.
    """
    col = lambda side, c: F.col(f"{side}.{c}")
    most = F.least(col(a, "shared") - col(a, "at"), col(b, "shared") - col(b, "at"))
    return (100 + percent) * most >= percent * (col(a, "size") + col(b, "size"))


def linked(sets: DataFrame, percent: int, staged: Staged, proposed: DataFrame | None = None) -> DataFrame:
    """(node, root) of the sets (node, size, hashes) that link with another: those of one component share a root.

    ``proposed`` (a, b) pairs of nodes are verified first, beside those of the shingles' centres.
    """
    tokens = staged.put(sets.select("node", "size", F.explode("hashes").alias("token")), "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    each = F.array_sort(F.collect_list(F.struct("df", "token")))  # a text's own shingles
    ranked = tokens.join(often, "token").groupBy("node", "size").agg(each.alias("r")).where(F.size("r") >= _ceil(F.col("size"), percent))
    ranked = staged.put(ranked.select("node", "size", F.col("r.df").alias("dfs"), F.col("r.token").alias("tokens")), "ranked")
    staged.drop("tokens")
    chosen = ranked.mapInArrow(trimmed(_levels(percent)), "node long, size long, shared long, level long, tokens array<struct<token:long,from:long,at:long>>")
    keyed = staged.put(chosen.select("node", "size", "shared", "level", F.inline("tokens")), "keyed")
    known = ranked.select("node", "size", "tokens")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Compared whole, in the JVM, a pair at a time; shingles that only one text of all has can't be shared."""
        x, y = (known.select(F.col("node").alias(s), F.col("size").alias(f"{s}_size"), F.col("tokens").alias(f"{s}_tokens")) for s in "ab")
        both = F.size(F.array_intersect("a_tokens", "b_tokens"))
        enough = 100 * both >= percent * (F.col("a_size") + F.col("b_size") - both)
        return staged.put(pairs.join(x, "a").join(y, "b").where(enough).select("a", "b"), name)

    prefix = ranked.select("node", (F.size("tokens") - _ceil(F.col("size"), percent)).alias("base"), "tokens")

    def often_met(pairs: DataFrame) -> DataFrame:
        """Those of (a, b, level) that share ``level`` shingles within the prefixes for it: the others can't link."""
        first = F.slice("tokens", F.lit(1), F.least(F.size("tokens"), F.col("base") + F.col("level")).cast("int"))
        one = pairs.join(prefix.withColumnRenamed("node", "a"), "a").select("a", "b", "level", first.alias("x"))
        both = one.join(prefix.withColumnRenamed("node", "b"), "b").select("a", "b", "level", "x", first.alias("y"))
        return both.where(F.size(F.array_intersect("x", "y")) >= F.col("level")).select("a", "b")

    # Each shingle's texts meet the one that has the fewest shingles of its own, in proportion.
    centre = keyed.groupBy("token").agg(F.max_by(F.struct("node", "size", "shared", "at"), F.struct(F.col("shared") / F.col("size"), "size", "node")).alias("centre"), F.count("*").alias("n"))
    centre = centre.where("n > 1").select("token", "centre.*")
    a, b = keyed.alias("a"), centre.alias("b")
    star = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.node") != F.col("b.node")) & _can_link("a", "b", percent))
    star = star.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))
    star = (star if proposed is None else star.union(proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))).distinct()
    roots = connect(verified(star, "star"), staged)
    staged.drop("star")

    # What is left: texts of different components that share a shingle of both prefixes. A pair is told at its first such shingle;
    # that one shared shingle is among the last BEFORE of both keeps most of its further ones out.
    comp = F.coalesce("root", "node")
    placed = staged.put(keyed.join(roots, "node", "left").withColumn("comp", comp).drop("root"), "placed")
    mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    start = F.greatest(F.lit(1), F.col("at") + 1 - BEFORE).cast("int")
    before = F.slice("tokens", start, F.least(F.col("at"), F.lit(BEFORE)).cast("int"))
    placed = staged.put(placed.join(mixed, "token", "left_semi").join(known.select("node", "tokens"), "node").withColumn("before", before).drop("tokens"), "mixed")
    a, b = placed.alias("a"), placed.alias("b")
    level = F.least("a.level", "b.level")
    meets = (F.col("a.token") == F.col("b.token")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.comp") != F.col("b.comp"))
    meets &= (F.greatest("a.from", "b.from") <= level) & _can_link("a", "b", percent) & ~F.arrays_overlap("a.before", "b.before")
    met = a.join(b, meets).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), level.alias("level"))
    pairs = staged.put(met.groupBy("a", "b").agg(F.first("level").alias("level")), "met")
    more = verified(often_met(pairs), "more")
    names = placed.select("node", "comp").distinct()
    between = more.join(names.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(names.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
    above = connect(between.select(F.col("ca").alias("a"), F.col("cb").alias("b")), staged).select(F.col("node").alias("comp"), F.col("root").alias("top"))
    every = keyed.select("node").distinct().join(roots, "node", "left").select("node", comp.alias("comp"))
    return staged.put(every.join(above, "comp", "left").select("node", F.coalesce("top", "comp").alias("root")), "joined")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """For every row its id, n_shingles (distinct word shingles) and component_id, the smallest id reachable by links.

    Two rows link if their sets of shingles share at least ``percent`` hundredths of their union (50 or more). A text of fewer
    words than a shingle has is one shingle; a null, empty or blank text has none and links with nothing, equal ones included.
    Equal sets link. A component whose ids are all null has a null component_id; repeated rows give repeated results. A text
    of any length is held whole by one task, and with its shingles 30 times its size. Extra columns are ignored. An empty
    table gives an empty result.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent: 50 to 100")
    staged = Staged(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, classes, sets = thinned(own, shingle, percent, staged)
    joined = linked(sets, percent, staged)
    rooted = classes.join(joined, "node", "left").select("k1", "k2", "first_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("least"))
    named = rooted.join(least, "root").select("k1", "k2", "least")
    out = rows.join(named, ["k1", "k2"], "left")
    component = F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') for i in generate_series(1, len(w) - 4)])) END AS s
  FROM w),
d AS (SELECT s, min(doc_id) AS doc_id, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
t AS (SELECT doc_id, n, unnest(s) AS token FROM d),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.token = b.token AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT d.s, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id FROM d LEFT JOIN r ON r.a = d.doc_id GROUP BY d.s, d.doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.s = s.s
"""
