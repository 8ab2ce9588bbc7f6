"""Best-fit packing of token sequences by bin completion.

Documents are tokenised and cut into pieces in one pass. What packing needs of them is the number of pieces of each length,
a table no longer than a sequence. Over it best-fit decreasing gives the first solution, and unless that meets the lower
bound, a branch-and-bound search completes one bin after the other: around the longest piece left it enumerates the fillings
that no other dominates, branches over them, and turns back where the waste so far rules out a bin less than the best
solution. A filling is applied to as many bins at once as the counts allow. Tasks then look up each piece's place by its
length and its rank among the pieces of that length.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import Staged, table, trimmed
from weftline.llm.token_counts import byte_alphabet

CAPACITY = 1024
#: Token that ends every document.
END = 2
#: Steps of the enumeration for one bin and of the whole search after which it settles for the best solution so far. The
#: problem is NP-hard, so some bound there must be; best-fit stands below it.
FILLING_NODES, SEARCH_NODES = 5_000, 100_000

Filling = tuple[tuple[int, int], ...]


def _dominated(counts: list[int], chosen: list[tuple[int, int]], waste: int) -> bool:
    """Whether a piece left out could stand for some pieces of the filling: for two or more of its size, or for smaller ones.

    ``counts``: pieces left beside the chosen. Sums of subsets are the bits of whole numbers. The empty subset has sum 0, so
    a piece that still fits dominates, too.
    """
    sums, several = 1, 0  # of any subset; of subsets of several pieces
    for n, k in chosen:
        for _ in range(k):
            several |= (several << n) | ((sums & ~1) << n)
            sums |= sums << n
    above, width = (sums << 1, 1) if waste else (0, 0)  # sums moved up by 1 .. waste
    while width < waste:
        step = min(width, waste - width)
        above |= above << step
        width += step
    return any(c and (above | several) >> n & 1 for n, c in enumerate(counts))


def fillings(counts: list[int], room: int, largest: int, most_waste: int, nodes: int = FILLING_NODES) -> tuple[list[tuple[int, Filling]], int]:
    """((waste, ((length, number), ...)) by rising waste, steps taken): the undominated fillings of ``room``.

    None of them wastes more than ``most_waste``. A piece that fills the room alone dominates everything else.
    """
    if not room:
        return [(0, ())], 1
    if room <= largest and counts[room]:
        return [(0, ((room, 1),))], 1
    below = [0] * (largest + 1)
    for n in range(1, largest + 1):
        below[n] = below[n - 1] + n * counts[n]
    lengths = [n for n in range(min(room, largest), 0, -1) if counts[n]]
    smallest = lengths[-1] if lengths else room + 1
    left = list(counts)
    chosen: list[tuple[int, int]] = []
    out: list[tuple[int, Filling]] = []
    steps = 0

    def extend(room: int, at: int) -> None:
        nonlocal steps
        steps += 1
        while at < len(lengths) and lengths[at] > room:
            at += 1
        if at == len(lengths) or room < smallest:
            if room <= most_waste and not _dominated(left, chosen, room):
                out.append((room, tuple(chosen)))
            return
        n = lengths[at]
        if steps >= nodes or room - below[n] > most_waste:
            return
        for k in range(min(left[n], room // n), 0, -1):
            chosen.append((n, k))
            left[n] -= k
            extend(room - n * k, at + 1)
            left[n] += k
            chosen.pop()
            if steps >= nodes:
                return
        extend(room, at + 1)

    extend(room, 0)
    return sorted(out, key=lambda f: (f[0], sum(k for _, k in f[1]))), steps


def lower_bound(counts: list[int], capacity: int) -> int:
    """Bins that any packing needs: by volume, and by pieces of which no two fit together plus what can't join them."""
    number = np.array(counts[: capacity + 1], np.int64)
    n = np.arange(capacity + 1)
    many, volume = np.concatenate(([0], np.cumsum(number))), np.concatenate(([0], np.cumsum(n * number)))  # of lengths below
    best = -(-int(volume[-1]) // capacity)
    half = capacity // 2 + 1
    for k in range(0, capacity // 2 + 1):
        big = capacity - k + 1  # from here on nothing of k or more fits beside
        alone, middle = many[-1] - many[big], many[big] - many[half]
        space = capacity * middle - (volume[big] - volume[half])
        small = volume[half] - volume[max(k, 1)]
        best = max(best, int(alone + middle + max(0, -(-(small - space) // capacity))))
    return best


def best_fit(counts: list[int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing: each piece, longest first, goes to the fullest bin that takes it. Equal bins are kept as one."""
    by_room: dict[int, list[tuple[Filling, int]]] = {capacity: []}
    for n in range(capacity, 0, -1):
        left = counts[n] if n < len(counts) else 0
        while left:
            room = next((r for r in range(n, capacity) if by_room.get(r)), capacity)
            # A bin that took one is then the fullest that takes the next, so each takes all it can.
            each = room // n
            filling, bins = by_room[room].pop() if room < capacity else ((), -(-left // each))
            full = min(bins, left // each)
            last = min(left - full * each, each) if full < bins else 0
            for number, k in ((full, each), (1 if last else 0, last), (bins - full - (1 if last else 0), 0)):
                if number:
                    by_room.setdefault(room - k * n, []).append(((*filling, (n, k)) if k else filling, number))
            left -= full * each + last
    return [group for groups in by_room.values() for group in groups]


def complete_bins(counts: list[int], capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> list[tuple[Filling, int]]:
    """(filling, number of bins) that hold ``counts[n]`` pieces of every length n <= capacity; never more bins than best-fit.

    Depth first: the choices of a bin are its undominated fillings by rising waste. A branch ends where its waste exceeds
    what a solution of one bin less than the best may waste in all.
    """
    left = list(counts[: capacity + 1]) + [0] * (capacity + 1 - len(counts))
    volume = sum(n * c for n, c in enumerate(left))
    best = best_fit(left, capacity)
    bins, bound = sum(times for _, times in best), lower_bound(left, capacity)
    waste = used = 0

    def options() -> list[tuple[int, Filling]]:
        """Undominated fillings around the longest piece left, the least wasteful at the end."""
        nonlocal nodes
        top = longest()
        left[top] -= 1
        found, steps = fillings(left, capacity - top, min(top, capacity - top), (bins - 1) * capacity - volume - waste, min(nodes, FILLING_NODES))
        left[top] += 1
        nodes -= steps
        return found[::-1]

    def longest() -> int:
        return next((n for n in range(capacity, 0, -1) if left[n]), 0)

    def change(need: Counter, times: int, lost: int) -> None:
        nonlocal waste, used
        for n, k in need.items():
            left[n] -= k * times
        waste += lost * times
        used += times

    # For each depth the fillings not yet tried, and the one that is applied.
    stack: list[list] = [[options(), None]] if bins > bound else []
    while stack and bins > bound:
        untried, applied = stack[-1]
        if applied:
            need, times, lost = applied
            change(need, -times, lost)
            stack[-1][1] = None
        if not untried or nodes <= 0:
            stack.pop()
            continue
        lost, rest = untried.pop()
        need = Counter(dict(rest))
        need[longest()] += 1
        spare = (bins - 1) * capacity - volume - waste
        times = min(left[n] // k for n, k in need.items())
        times = min(times, spare // lost) if lost else times
        if spare < 0 or times < 1:
            continue
        change(need, times, lost)
        stack[-1][1] = (need, times, lost)
        if longest():
            stack.append([options(), None])
        elif used < bins:
            bins = used
            best = [(tuple(sorted(n.items(), reverse=True)), t) for n, t, _ in (frame[1] for frame in stack)]
    return best


class Tokenizer:
    """Token ids of a byte-level vocabulary file, as an array. Texts that spell a special token go through ``tokenizers``."""

    def __init__(self, described: str):
        import tiktoken

        model = json.loads(described)
        self.described, self.slow = described, None
        self.special = [t["content"] for t in model["added_tokens"]]
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in w): i for w, i in model["model"]["vocab"].items() if w not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            if self.slow is None:
                from tokenizers import Tokenizer as Slow

                self.slow = Slow.from_str(self.described)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


#: Tokenizers that this Python worker has built, by the checksum of the vocabulary.
_ready: dict[int, Tokenizer] = {}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but perhaps the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(batches: Iterator[pa.RecordBatch], described, capacity: int) -> Iterator[pa.RecordBatch]:
    key, vocabulary = described.value
    tokenize = _ready.get(key) or _ready.setdefault(key, Tokenizer(vocabulary))
    part, ranks = TaskContext.get().partitionId(), [0] * (capacity + 1)
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.append(tokenize(text.as_py() or ""), END).astype("<u4")
            for k, (start, length) in enumerate(cut(len(ids), capacity)):
                rows.append((doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, ranks[length]))
                ranks[length] += 1
        names = ["id", "piece", "start", "length", "ids_crc32", "part", "rank"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=names)


def places(solution: list[tuple[Filling, int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length, (first rank, first bin, pieces a bin, offset of the first) of each filling that uses it, by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    bins = 0
    for filling, times in solution:
        offset = 0
        for n, k in filling:
            out.setdefault(n, []).append((used.get(n, 0), bins, k, offset))
            used[n] = used.get(n, 0) + k * times
            offset += n * k
        bins += times
    return out


def _placed(batches: Iterator[pa.RecordBatch], where: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            found = where[int(n)]
            row = found[np.searchsorted(found[:, 0], rank[at], side="right") - 1]
            later = rank[at] - row[:, 0]
            sequence[at] = row[:, 1] + later // row[:, 2]
            offset[at] = row[:, 3] + later % row[:, 2] * n
        kept = [batch[c] for c in ("id", "piece", "start", "length", "ids_crc32")]
        yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are tokenised whole, END is appended, and only what is longer than ``capacity`` is cut. Null and empty texts are
    one piece of END alone. Repeated rows and null ids are packed like any other. Extra columns are ignored. An empty table
    gives an empty result. A text of any length is tokenised by one task, which holds it and its ids. The driver sees one count
    for each length and returns at most a few places for each, whatever the number of documents.
    """
    spark = docs.sparkSession
    staged = Staged(spark)
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read()
    described = spark.sparkContext.broadcast((zlib.crc32(text.encode()), text))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
    pieces = staged.put(rows.mapInArrow(trimmed(lambda batches: _pieces(batches, described, capacity)), schema), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = [0] * (capacity + 1)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    where = spark.sparkContext.broadcast({n: np.array(rows, np.int64) for n, rows in places(complete_bins(counts, capacity)).items()})
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "part")
    placed = ranked.mapInArrow(lambda batches: _placed(batches, where.value), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)


def op9_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return pack(table(spark, sf_dir, "documents"), vocabulary)
