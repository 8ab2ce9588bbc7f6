"""Removal of repeated 200-byte strings by a distributed sort of suffixes.

A window is LENGTH bytes at some place of a text. Its anchor is the smallest-hashed GRAM bytes in it, so equal windows have
their anchors at equal places, and all windows of one anchor form a block of a text.

1. Every text gives its blocks: hashes of the anchor's GRAM bytes and of the whole block. Anchors that occur once can't lie
   in a repeated window; blocks that occur twice as a whole are repeated throughout. What is left are the blocks at the
   borders of repeats.
2. Only these are fetched, each as a suffix: the text from its anchor on, then what stands before the anchor, read backwards.
   Tasks sort them into runs, cut the runs at sampled splitters, and exchange them front-coded, without the bytes that a
   suffix shares with the one before it.
3. A loser tree merges the runs of a range. Every suffix carries its known common prefix with the last one given out, so bytes
   known to be equal are never compared again. These common prefixes decide: two blocks share a window if they agree far
   enough to the right of the anchor, by the merge's prefixes, and to the left of it, by those of the parts before it,
   sorted within the anchor's group. Splitters are anchors, so no group is cut; an anchor with more than HOT different
   blocks enters window by window instead, and there a window is repeated if a neighbour shares all of its bytes.
4. The repeated windows of each text are joined to it, and the bytes they cover go.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Staged, table

LENGTH = 200
#: Bytes of an anchor; places in a window where it may start.
GRAM = 64
PLACES = LENGTH - GRAM + 1
#: Windows of a text that are handled at a time, suffixes in a run, windows compared at a time.
CHUNK, RUN, COMPARE = 1 << 20, 20_000, 1 << 20
#: Suffixes that a range is meant to hold, sampled suffixes for each range, and ranges at most: the driver sees no more than
#: SAMPLE * MOST_RANGES keys of GRAM bytes. Ranges grow only beyond RANGE * MOST_RANGES suffixes.
RANGE, SAMPLE, MOST_RANGES = 50_000, 8, 50_000
#: Different blocks around one anchor beyond which their windows are sorted one by one, so that they spread over ranges.
HOT = 50_000
_PLACE_BITS = np.uint64(28)
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b])) | 1 for b in range(256)], np.uint64)
_HEAD = struct.Struct("<HHHBqqI")


class Powers:
    """Powers of the hash's base and of its inverse, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up), 4096)
            for name, factor in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                full = np.full(size, factor, np.uint64)
                full[0] = 1
                setattr(self, name, np.multiply.accumulate(full))
        return self.up, self.down


_powers = Powers()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _prefix_hash(data: np.ndarray) -> np.ndarray:
    up, _ = _powers.reach(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=out[1:])
    return out


def _hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end; where they stand doesn't matter."""
    return _mix((prefix[end] - prefix[start]) * _powers.down[start])


def _least_within(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from minima to either side of fixed borders."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def blocks(text: bytes) -> tuple[np.ndarray, ...]:
    """(gram hash, block hash, first window, last window, anchor) of every block; windows are named by their first byte."""
    found = []
    for at in range(0, max(0, len(text) - LENGTH + 1), CHUNK):
        data = np.frombuffer(text, np.uint8)[at : at + CHUNK + LENGTH - 1]
        prefix = _prefix_hash(data)
        grams = np.arange(len(data) - GRAM + 1)
        hashed = _hash(prefix, grams, grams + GRAM)
        ranked = (hashed >> _PLACE_BITS << _PLACE_BITS) | grams.astype(np.uint64)
        anchors = (_least_within(ranked, PLACES) & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
        change = np.flatnonzero(np.diff(anchors)) + 1
        first, last = np.concatenate(([0], change)), np.concatenate((change - 1, [len(anchors) - 1]))
        anchor = anchors[first]
        shape = ((anchor - first) * 4096 + (last - first)).astype(np.uint64)
        # Of another family than the anchors' hash: blocks of one anchor are one kind only if both agree.
        held = data.tobytes()
        own = np.fromiter((xxhash.xxh3_64_intdigest(held[a:b]) for a, b in zip(first.tolist(), (last + LENGTH).tolist())), np.uint64, len(first))
        whole = _mix(own ^ shape * np.uint64(_BASE))
        found.append((hashed[anchor], whole, first + at, last + at, anchor + at))
    if not found:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(map(np.concatenate, zip(*found)))


_BLOCKS = "k1 long, k2 long, gram long, whole long, first int, last int, anchor int"


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["k1", "k2", "gram", "whole", "first", "last", "anchor"]
    for batch in batches:
        k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
        rows, owner, held = [], [], 0
        for i, text in enumerate(batch["text"]):
            found = blocks(text.as_py())
            if len(found[0]):
                rows.append(found)
                owner.append((i, len(found[0])))
                held += len(found[0])
            if rows and (held > 200_000 or i == batch.num_rows - 1):
                gram, whole, *places = map(np.concatenate, zip(*rows))
                of = np.repeat([o for o, _ in owner], [n for _, n in owner])
                columns = [k1[of], k2[of], gram.view(np.int64), whole.view(np.int64), *(c.astype(np.int32) for c in places)]
                yield pa.record_batch([pa.array(c) for c in columns], names=names)
                rows, owner, held = [], [], 0


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes needn't be looked at."""
    end = min(len(a), len(b))
    if a[known:end] == b[known:end]:
        return end
    step = 16
    while a[known : known + step] == b[known : known + step]:
        known += step
        step *= 2
    while step > 1:
        step //= 2
        if a[known : known + step] == b[known : known + step]:
            known += step
    return known


Item = tuple[bytes, int, tuple]


def front_code(items: list[tuple[bytes, tuple]]) -> bytes:
    """Sorted (suffix, (length before the anchor, repeated, k1, k2, first)) as one compressed piece of a run."""
    out, before = [], b""
    for suffix, (left, repeated, k1, k2, first) in items:
        n = common_prefix(before, suffix)
        out.append(_HEAD.pack(n, len(suffix) - n, left, repeated, k1, k2, first) + suffix[n:])
        before = suffix
    return zlib.compress(b"".join(out), 1)


def front_decode(piece: bytes) -> Iterator[Item]:
    """(suffix, common prefix with the one before, rest) of a piece."""
    data, at, before = zlib.decompress(piece), 0, b""
    while at < len(data):
        n, more, left, repeated, k1, k2, first = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        before = before[:n] + data[at : at + more]
        at += more
        yield before, n, (left, repeated, k1, k2, first)


def merge(runs: list[Iterator[Item]]) -> Iterator[Item]:
    """One sorted stream, each suffix with its common prefix with the one before.

    A loser tree: every inner node keeps the loser of its match and the loser's common prefix with the winner that passed.
    When the next suffix of the winner's run climbs up, its known prefix and the losers' are prefixes of the same last
    output: the longer one wins without a look, and equal ones are compared from there on.
    """
    width = 1
    while width < len(runs):
        width *= 2
    ends = (None, -1, None)
    heads: list = [next(r, ends) for r in runs] + [ends] * (width - len(runs))
    known = [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes that with the winner."""
        x, y = heads[a][0], heads[b][0]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = common_prefix(x, y, known[a])
        if x[n : n + 1] <= y[n : n + 1]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    tree = [0] * width
    up = list(range(width))
    while len(up) > 1:  # the first round of matches, from the leaves
        rest, base = [], len(up) // 2
        for i in range(base):
            win, lose = play(up[2 * i], up[2 * i + 1])
            tree[base + i] = lose
            rest.append(win)
        up = rest
    win = up[0]
    while heads[win][0] is not None:
        yield heads[win][0], known[win], heads[win][2]
        heads[win] = next(runs[win], ends)
        known[win] = heads[win][1]
        node = (win + width) // 2
        while node:
            win, lose = play(win, tree[node])
            tree[node] = lose
            node //= 2


def repeated_windows_of(right: np.ndarray, suffixes: list[bytes], rests: list[tuple]) -> np.ndarray:
    """(suffixes, PLACES) flags: whether the window that starts d bytes before the anchor occurs in another block, too.

    ``suffixes`` are whole groups in merged order and ``right`` their common prefixes with the one before, as the merge gave
    them; borders of groups are below GRAM. Two blocks share the window at d if they share LENGTH - d bytes from the anchor
    on and d bytes before it. To either side those are classes of neighbours in sorted order whose common prefixes reach
    so far, and windows that agree in both classes are equal. A block marked as repeated counts twice.
    """
    n = len(suffixes)
    before = np.array([r[0] for r in rests])
    ahead = np.array([len(s) for s in suffixes]) - before
    twice = np.array([r[1] for r in rests], np.int64)
    group = np.cumsum(right < GRAM)
    lefts = [s[len(s) - r[0] :] for s, r in zip(suffixes, rests)]
    order = sorted(range(n), key=lambda i: (group[i], lefts[i]))
    left = np.array([-1] + [common_prefix(lefts[a], lefts[b]) if group[a] == group[b] else -1 for a, b in zip(order, order[1:])])
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    out = np.zeros((n, PLACES), bool)
    for d in range(PLACES):
        at = np.flatnonzero((before >= d) & (ahead >= LENGTH - d))
        if not len(at):
            continue
        same = np.cumsum(right < LENGTH - d)[at] * (n + 1) + np.cumsum(left < d)[back[at]]
        _, which, counts = np.unique(same, return_inverse=True, return_counts=True)
        out[at, d] = (counts + np.bincount(which, twice[at], len(counts)).astype(np.int64))[which] > 1
    return out


_FOUND = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
_FOUND_DDL = "k1 long, k2 long, first int, last int"


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The pieces of each range of a task."""
    ranges: dict[int, list[bytes]] = {}
    for batch in batches:
        for number, piece in zip(batch["range"].to_pylist(), batch["piece"].to_pylist()):
            ranges.setdefault(number, []).append(piece)
    for number in sorted(ranges):
        yield ranges.pop(number)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of runs to the repeated windows of their blocks. Groups are never cut by a splitter."""

    def decided(suffixes: list[bytes], right: list[int], rests: list[tuple]) -> pa.RecordBatch:
        flags = repeated_windows_of(np.array(right), suffixes, rests) & ~np.array([r[1] > 0 for r in rests])[:, None]
        edges = np.diff(np.pad(flags[:, ::-1], ((0, 0), (1, 1))).astype(np.int8), axis=1)  # by rising first byte
        owner, begin = np.nonzero(edges == 1)
        _, end = np.nonzero(edges == -1)
        k1, k2 = (np.array([r[j] for r in rests], np.int64)[owner] for j in (2, 3))
        anchor = np.array([r[4] + r[0] for r in rests], np.int64)[owner]
        first, last = anchor - (PLACES - 1) + begin, anchor - (PLACES - 1) + end - 1
        return pa.record_batch([pa.array(k1), pa.array(k2), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], schema=_FOUND)

    for pieces in _by_range(batches):
        held: tuple[list, list, list] = ([], [], [])
        for suffix, n, rest in merge([front_decode(p) for p in pieces]):
            if n < GRAM and len(held[0]) * PLACES > COMPARE:
                yield decided(*held)
                held = ([], [], [])
            for column, value in zip(held, (suffix, n if held[0] else -1, rest)):
                column.append(value)
        if held[0]:
            yield decided(*held)


def _merged_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of runs of single windows to those with a neighbour that shares all LENGTH bytes, or marked as repeated."""
    for pieces in _by_range(batches):
        rows: list[tuple] = []
        before: tuple | None = None  # the first of a group, as long as it is alone

        def hit(rest: tuple) -> None:
            if not rest[1]:
                rows.append((rest[2], rest[3], rest[4], rest[4]))

        for _, n, rest in merge([front_decode(p) for p in pieces]):
            if n >= LENGTH:
                if before:
                    hit(before)
                hit(rest)
                before = None
            else:
                before = rest
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND.types)], schema=_FOUND)


def _runs(batches: Iterator[pa.RecordBatch], splitters: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Suffix rows to sorted runs, cut at the splitters and front-coded."""
    held: list[tuple[bytes, tuple]] = []
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("suffix", "before", "repeated", "k1", "k2", "first")]
        for suffix, *rest in zip(*columns):
            held.append((suffix, tuple(rest)))
            if len(held) == RUN:
                yield _pieces(sorted(held), splitters)
                held = []
    if held:
        yield _pieces(sorted(held), splitters)


def _pieces(run: list[tuple[bytes, tuple]], splitters: list[bytes]) -> pa.RecordBatch:
    ranges, out, at = [], [], 0
    while at < len(run):
        k = bisect_right(splitters, run[at][0])
        # A suffix equal to a splitter goes to the range above it.
        end = bisect_left(run, (splitters[k],), at) if k < len(splitters) else len(run)
        ranges.append(k)
        out.append(front_code(run[at:end]))
        at = end
    return pa.record_batch([pa.array(ranges, pa.int32()), pa.array(out, pa.binary())], names=["range", "piece"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, tuple]]]:
    """Suffix rows to sorted runs of all their windows, each with no bytes before its start."""
    held: list[tuple[bytes, tuple]] = []
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("suffix", "before", "repeated", "k1", "k2", "first")]
        for suffix, before, repeated, k1, k2, first in zip(*columns):
            block = suffix[len(suffix) - before :][::-1] + suffix[: len(suffix) - before]
            held.extend((block[p : p + LENGTH], (0, repeated, k1, k2, first + p)) for p in range(len(block) - LENGTH + 1))
            if len(held) >= RUN:
                yield sorted(held)
                held = []
    if held:
        yield sorted(held)


def _window_runs(batches: Iterator[pa.RecordBatch], splitters: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Runs of single windows. Equal ones in a run are settled here and go on as one, marked as repeated, so that a
    window of very many blocks arrives once from each run: rows of (range, piece) and rows of (k1, k2, first, last)."""
    for run in _windows(batches):
        once, found, at = [], [], 0
        while at < len(run):
            end = at + 1
            while end < len(run) and run[end][0] == run[at][0]:
                end += 1
            _, repeated, *rest = run[at][1]
            if end - at > 1:
                found.extend((r[2], r[3], r[4], r[4]) for _, r in run[at:end] if not r[1])
                repeated = 1
            once.append((run[at][0], (0, repeated, *rest)))
            at = end
        pieces = _pieces(once, splitters)
        nothing = [pa.nulls(pieces.num_rows, t) for t in _FOUND.types]
        yield pa.record_batch([*pieces.columns, *nothing], names=["range", "piece", *_FOUND.names])
        if found:
            spans = [pa.array(c, t) for c, t in zip(zip(*found), _FOUND.types)]
            yield pa.record_batch([pa.nulls(len(found), pa.int32()), pa.nulls(len(found), pa.binary()), *spans], names=["range", "piece", *_FOUND.names])


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text, wanted blocks) to a suffix for each block."""
    names = ["suffix", "before", "repeated", "k1", "k2", "first", "hot"]
    types = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
    for batch in batches:
        rows = []
        for k1, k2, text, wanted in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), batch["text"], batch["wanted"].to_pylist()):
            data = text.as_py()
            for w in wanted:
                before = data[w["first"] : w["anchor"]]
                rows.append((data[w["anchor"] : w["last"] + LENGTH] + before[::-1], len(before), int(w["n"] > 1), k1, k2, w["first"], w["hot"]))
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _one_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A window of each suffix row, any of them with the same chance, as (key, at)."""
    for batch in batches:
        keys, at = [], []
        for suffix, before, k1, first in zip(*(batch[c].to_pylist() for c in ("suffix", "before", "k1", "first"))):
            block = suffix[len(suffix) - before :][::-1] + suffix[: len(suffix) - before]
            p = (k1 ^ first * _BASE) % (len(block) - LENGTH + 1)
            keys.append(block[p : p + LENGTH])
            at.append(k1 ^ first)
        yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(at, pa.int64())], names=["key", "at"])


def _splitters(keys: DataFrame, weight: int = 1) -> tuple[int, list[bytes]]:
    """Number of ranges and the keys between them for (key, at) rows; both bounded by MOST_RANGES, whatever the input."""
    total = keys.count()
    width = min(MOST_RANGES, max(1, -(-total * weight // RANGE)))
    if width == 1:
        return 1, []
    share = min(1.0, SAMPLE * width / total)  # by hash, so that no task or driver sorts more than the sample
    sample = keys.where(F.pmod(F.xxhash64("key", "at"), F.lit(1 << 31)) < int(share * (1 << 31))).select("key").collect()
    ordered = sorted(bytes(r["key"]) for r in sample)
    return width, sorted({ordered[i * len(ordered) // width] for i in range(1, width)}) if ordered else []


def remove(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs, the rest) for repeated windows given as (first, last), in any order, also repeated."""
    kept, removed, runs, at, end = [], 0, 0, 0, -1
    for a, b in sorted(spans):
        if a > end:  # neither overlaps nor touches the run before
            if end >= 0:
                removed += end - at
                runs += 1
            kept.append(text[max(end, 0) : a])
            at = a
        end = max(end, b + LENGTH)
    if end >= 0:
        removed += end - at
        runs += 1
    kept.append(text[max(end, 0) :])
    return removed, runs, b"".join(kept)


def _rows_without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch["text"], batch["spans"].to_pylist()):
            data = text.as_py()
            out.append((len(data), *remove(data, [(s["first"], s["last"]) for s in spans or ()])))
        n, removed, runs, rest = zip(*out) if out else ([], [], [], [])
        yield pa.record_batch(
            [batch["id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(rest, pa.binary())],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text as bytes, and 128 bits of its hash: equal texts share whatever is found in one of them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"))


def repeated_windows(docs: DataFrame, staged: Staged, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, first, last): ranges of the repeated windows of every distinct text, maybe several times."""
    texts = _keyed(docs, id_col, text_col)
    every = staged.put(texts.select("k1", "k2", "text").mapInArrow(_block_rows, _BLOCKS), "blocks")
    # Written, so that the join below shuffles both sides itself and may split a hot anchor.
    often = staged.put(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "often")
    maybe = staged.put(every.join(often, "gram"), "maybe")
    staged.drop("blocks", "often")
    firsts = [F.first(c).alias(c) for c in ("k1", "k2", "first", "last", "anchor")]
    kinds = staged.put(maybe.groupBy("gram", "whole").agg(F.count("*").alias("n"), *firsts), "kinds")
    inside = maybe.join(kinds.where("n > 1").select("gram", "whole"), ["gram", "whole"]).select("k1", "k2", "first", "last").distinct()
    # (kinds of a gram, whether any occurs once): only where one does is something open.
    mixed = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1")
    mixed = mixed.select("gram", (F.col("kinds") > HOT).alias("hot"))
    wanted = kinds.join(mixed, "gram").groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last", "anchor", "n", "hot")).alias("wanted"))
    # Of texts that occur several times, the row of smallest id is read.
    chosen = texts.groupBy("k1", "k2").agg(F.min(F.coalesce("id", F.lit(-(1 << 63)))).alias("chosen"))
    asked = staged.put(wanted.join(chosen, ["k1", "k2"]), "asked")
    source = texts.join(asked, ["k1", "k2"]).where(F.coalesce("id", F.lit(-(1 << 63))) == F.col("chosen"))
    suffixes = staged.put(
        source.select("k1", "k2", "text", "wanted").mapInArrow(_fetched, "suffix binary, before int, repeated int, k1 long, k2 long, first int, hot boolean"), "suffixes"
    )
    # A splitter is an anchor's bytes, so the suffixes of one anchor lie in one range.
    groups = suffixes.where("NOT hot")
    width, splitters = _splitters(groups.select(F.substring("suffix", 1, GRAM).alias("key"), F.struct("k1", "first").alias("at")))
    runs = groups.mapInArrow(lambda batches: _runs(batches, splitters), "range int, piece binary")
    found = runs.repartitionById(width, F.col("range")).mapInArrow(_merged, _FOUND_DDL)
    hot = suffixes.where("hot")
    if not hot.isEmpty():
        # An anchor of very many blocks: every window for itself, so that any splitter may part them.
        keys = hot.mapInArrow(_one_window, "key binary, at long")
        wide, cuts = _splitters(keys, PLACES)
        single = staged.put(hot.mapInArrow(lambda batches: _window_runs(batches, cuts), f"range int, piece binary, {_FOUND_DDL}"), "windows")
        merged = single.where("piece IS NOT NULL").select("range", "piece").repartitionById(wide, F.col("range")).mapInArrow(_merged_windows, _FOUND_DDL)
        found = found.unionByName(merged).unionByName(single.where("piece IS NULL").select(*_FOUND.names))
    return inside.unionByName(found)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept (the bytes left) for every row.

    Every byte is removed that lies in LENGTH bytes which also start anywhere else, in the same text or another, judged on
    the texts as given; matches don't cross texts. Null texts count as empty, and texts shorter than LENGTH lose nothing.
    Repeated rows count as different texts, so texts of LENGTH bytes and more that occur twice are removed in full. Null
    ids are allowed; extra columns are ignored; an empty table gives an empty result. A text of any length is read by one task,
    whose windows are handled CHUNK at a time; the text itself is held whole, as is the list of its removed runs.
    """
    staged = Staged(docs.sparkSession)
    spans = repeated_windows(docs, staged, id_col, text_col).groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    spans = staged.put(spans, "spans")
    staged.drop("maybe", "kinds", "asked", "suffixes", "windows")
    whole = _keyed(docs, id_col, text_col).join(spans, ["k1", "k2"], "left").select("id", "text", "spans")
    kept = whole.mapInArrow(_rows_without, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return kept.withColumnRenamed("id", id_col)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
