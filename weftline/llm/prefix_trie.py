"""The trie of conversation prefixes by chained digests.

1. Turns are numbered within their conversation; a turn is stood for by a digest of its role and text, so that no text is
   shuffled. Chaining the digests gives every prefix of a conversation a digest of its own: SHA-256 of the digest before it
   and the turn's.
2. Every prefix is one row. Grouped by (depth, digest) they are the nodes; a node is named by its smallest member and its depth.
3. The nodes of one name are a chain, the end part of that member's own path, as the smallest member can only rise with the
   depth. So the sums over subtrees are sums along such chains, of which each also goes to every ancestor above its head. The
   rows of the prefixes are these pairs already: no row is made for each pair of node and ancestor, which a deep conversation
   would have in the square of its depth.
4. The members that end at a node are hashed in the order of their numbers: ranges of them are joined to texts of bounded size
   in many tasks, then these texts go through SHA-256 in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import Staged, shuffle_width, table

#: Conversations of a block share the first turns of the block's first; at most this many, less one, are taken.
BLOCK, HEADS = 20, 4
#: Characters of joined numbers in one row.
_TEXT = 1 << 16
_WORD = r"[^\x20\x09-\x0D]+"
_ROOT = hashlib.sha256(b"").digest()


def numbered_turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(c, pos from 1, turn: digest, words) of every turn: by turn (null first), role, then the digest of the text."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("c"),
        F.col(turn_col).alias("at"),
        role.alias("role"),
        F.sha2(text, 256).alias("text_digest"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )
    order = Window.partitionBy("c").orderBy(F.col("at").asc_nulls_first(), "role", "text_digest")
    turn = F.unhex(F.sha2(F.concat(F.sha2("role", 256), F.col("text_digest")), 256))
    return rows.select("c", F.row_number().over(order).cast("long").alias("pos"), turn.alias("turn"), "words")


def rebuilt(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """(c, pos, turn, words): numbered ``turns`` with the first h of each conversation replaced by those of c - c % block.

    h is the unsigned CRC-32 of c's decimal form modulo ``heads``. If that conversation is absent, the first h go without
    replacement. The remainder of a negative c is Spark's (towards zero).
    """
    h = F.crc32(F.col("c").cast("string").cast("binary")) % heads
    own = turns.withColumn("h", h).where("pos > h")
    convs = turns.where("pos = 1").select("c", (F.col("c") - F.col("c") % block).alias("base"), h.alias("h")).where("h > 0")
    first = turns.where(F.col("pos").between(1, heads - 1) & (F.col("c") % block == 0)).select(F.col("c").alias("base"), "pos", "turn", "words")
    taken = convs.join(first, "base").where("pos <= h").select("c", "pos", "turn", "words")
    # A conversation that is shorter than h gives fewer turns; the chain numbers anew, so that leaves no gap.
    return taken.union(own.select("c", "pos", "turn", "words"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (c, pos) to (c, depth, digest, words). Holds the last digest."""
    now, depth, digest = None, 0, _ROOT
    for batch in batches:
        cs, depths, digests = batch["c"].to_pylist(), [], []
        for c, turn in zip(cs, batch["turn"].to_pylist()):
            if c != now:
                now, depth, digest = c, 0, _ROOT
            depth += 1
            digest = hashlib.sha256(digest + turn).digest()
            depths.append(depth)
            digests.append(digest)
        yield pa.record_batch([batch["c"], pa.array(depths, pa.int64()), pa.array(digests, pa.binary()), batch["words"]], names=["c", "depth", "digest", "words"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv_id, depth, c) to (conv_id, depth, least, text): members in comma-joined texts of bounded size."""
    key, least, parts, size = None, None, [], 0
    for batch in batches:
        out = []
        for conv, depth, c in zip(*(batch[n].to_pylist() for n in ("conv_id", "depth", "c"))):
            if (conv, depth) != key or size > _TEXT:
                if parts:
                    out.append((*key, least, ",".join(parts)))
                key, least, parts, size = (conv, depth), c, [], 0
            parts.append(str(c))
            size += len(parts[-1]) + 1
        if out:
            yield _rows(out, ("conv_id", "depth", "least"), "text")
    if parts:
        yield _rows([(*key, least, ",".join(parts))], ("conv_id", "depth", "least"), "text")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv_id, depth, least) to (conv_id, depth, ends_sha256). Holds one state of SHA-256."""
    key, state = None, None
    for batch in batches:
        out = []
        for conv, depth, text in zip(*(batch[n].to_pylist() for n in ("conv_id", "depth", "text"))):
            if (conv, depth) == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (conv, depth), hashlib.sha256()
            state.update(text.encode())
        if out:
            yield _rows(out, ("conv_id", "depth"), "ends_sha256")
    if key is not None:
        yield _rows([(*key, state.hexdigest())], ("conv_id", "depth"), "ends_sha256")


def _rows(rows: list[tuple], numbers: tuple[str, ...], last: str) -> pa.RecordBatch:
    kinds = [pa.int64()] * len(numbers) + [pa.string()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[*numbers, last])


def ends(members: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of (conv_id, depth, c): the digest of the sorted members, joined by commas.

    Members are range-partitioned with their number, so that a node of very many is joined to texts in many tasks.
    """
    n = shuffle_width(members.sparkSession)
    placed = members.repartitionByRange(n, "conv_id", "depth", "c").sortWithinPartitions("conv_id", "depth", "c")
    texts = placed.mapInArrow(_joined, "conv_id long, depth long, least long, text string")
    ordered = texts.repartition(n, "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "least")
    return ordered.mapInArrow(_hashed, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(prefixes: DataFrame, convs: DataFrame, staged: Staged) -> DataFrame:
    """The nodes of (c, depth, digest, words) rows, one for every prefix but the empty one; ``convs`` (c) has all members.

    Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    A node's digest holds all turns before it, so equal digests are equal prefixes (but for a collision of SHA-256).
    """
    nodes = prefixes.groupBy("depth", "digest").agg(F.min("c").alias("owner"), F.count("*").alias("n_convs"), F.first("words").alias("words"))
    paths = staged.put(prefixes.select("c", "depth", "digest").join(nodes, ["depth", "digest"]).select("c", "depth", "owner", "n_convs", "words"), "paths")
    total = convs.agg(F.min("c").alias("root"), F.count("*").alias("all_convs"))

    # Along a path: the owner one step above (null: the root), and whether the path ends here.
    way = Window.partitionBy("c").orderBy("depth")
    steps = paths.withColumns({"above": F.lag("owner").over(way), "last": F.lead("depth").over(way).isNull()})
    steps = staged.put(steps, "steps")
    own = steps.where("owner = c")
    children = own.groupBy(F.col("above").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    below = children.where("conv_id IS NOT NULL")
    own = own.withColumnRenamed("c", "conv_id").join(below, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = own.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    chain = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    own = staged.put(own.withColumns({"chain_leaves": F.sum("leaf").over(chain), "chain_saved": F.sum("saved").over(chain)}), "own")

    # The sums of a whole chain go to all ancestors of its head: the nodes on its member's path that others own.
    chains = own.groupBy("conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    above = steps.where("owner <> c").select("c", F.col("owner").alias("conv_id"), "depth")
    given = above.join(chains.withColumnRenamed("conv_id", "c"), "c").groupBy("conv_id", "depth").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))

    inner = own.join(given, ["conv_id", "depth"], "left").crossJoin(F.broadcast(total)).select(  # one row
        "conv_id", "depth", F.coalesce("above", "root").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("chain_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("chain_saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
    )
    whole = own.agg(F.sum((F.col("depth") == 1).cast("long")).alias("n"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    root = total.where("all_convs > 0").crossJoin(whole).select(  # two single rows
        F.col("root").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.col("all_convs").alias("n_convs"), F.coalesce("n", F.lit(0)).alias("n_children"),
        F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
    )

    stops = steps.where("last").select(F.col("owner").alias("conv_id"), "depth", "c")
    turnless = convs.join(prefixes.where("depth = 1").select("c"), "c", "left_anti").crossJoin(F.broadcast(total))
    stops = stops.union(turnless.select(F.col("root").alias("conv_id"), F.lit(0).cast("long").alias("depth"), "c"))
    hashes = ends(staged.put(stops, "stops"))
    empty = hashlib.sha256(b"").hexdigest()
    return inner.union(root).join(hashes, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))


def conversation_trie(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", share_heads: bool = False
) -> DataFrame:
    """One row for each distinct prefix (role, text) of the conversations, the textless root included; see ``prefix_trie``.

    ``share_heads`` rebuilds the conversations first (``rebuilt``). Null role or text counts as empty; rows without an id
    take no part; a null turn comes first. Rows of equal turn, repeated ones included, are all turns of their own, in the
    order of role, then of the text's SHA-256. Texts of any length are digested where they are read. Extra columns are
    ignored. Without any conversation there is no node.
    """
    spark = turns.sparkSession
    staged = Staged(spark)
    numbered = staged.put(numbered_turns(turns, id_col, turn_col, role_col, text_col), "turns")
    convs = numbered.where("pos = 1").select("c")
    rows = rebuilt(numbered) if share_heads else numbered
    n = shuffle_width(spark)
    ordered = rows.repartition(n, "c").sortWithinPartitions("c", "pos")
    prefixes = staged.put(ordered.mapInArrow(_chained, "c long, depth long, digest binary, words long"), "prefixes")
    return prefix_trie(prefixes, convs, staged)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), share_heads=True)


OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn
  FROM conversations WHERE conv_id IS NOT NULL),
bits AS (  -- CRC-32 of the decimal form, a bit at a time
  SELECT c, CAST(c AS VARCHAR) AS s, CAST(0 AS BIGINT) AS i, CAST(4294967295 AS BIGINT) AS x FROM (SELECT DISTINCT c FROM t)
  UNION ALL
  SELECT c, s, i + 1, CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END
  FROM (SELECT c, s, i, CASE WHEN i % 8 = 0 THEN xor(x, CAST(ascii(s[i // 8 + 1]) AS BIGINT)) ELSE x END AS y FROM bits WHERE i < 8 * length(s))),
h AS (SELECT c, xor(x, 4294967295) % 4 AS h, c - c % 20 AS base FROM bits WHERE i = 8 * length(s)),
r AS (
  SELECT h.c, t.pos, t.turn FROM h JOIN t ON t.c = h.base WHERE t.pos <= h.h
  UNION ALL SELECT t.c, t.pos, t.turn FROM t JOIN h USING (c) WHERE t.pos > h.h),
l AS (SELECT h.c, coalesce(list(r.turn ORDER BY r.pos) FILTER (WHERE r.pos IS NOT NULL), []) AS turns FROM h LEFT JOIN r USING (c) GROUP BY h.c),
p AS (SELECT c, d AS depth, len(turns) = d AS ends, turns[1:d] AS path FROM l, unnest(generate_series(0, len(turns))) AS g(d)),
n AS (
  SELECT depth, path, min(c) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')) END AS saved,
         sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM p GROUP BY depth, path),
k AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, path)),
s AS (SELECT a AS depth, path[1:a] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
      FROM f, unnest(generate_series(0, f.depth)) AS g(a) GROUP BY ALL)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (depth, path) LEFT JOIN f q ON q.depth = f.depth - 1 AND q.path = f.path[1:f.depth - 1]
"""
