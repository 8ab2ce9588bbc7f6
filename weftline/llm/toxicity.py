"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

Each word enters as the sum of two learnt inputs: the embedding of its hash, and the largest values among the embeddings of
its character n-grams (with marks for the word's ends). Two gated recurrent layers read a window of words in either direction, attention
pools their states, and a logistic unit scores the window. Overlapping windows cover the whole text; the text's score is
that of its highest window, and in training the same window carries the gradient.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table

#: Words in a window, and words between the starts of two windows.
WINDOW, STRIDE = 32, 16
#: Hash buckets of words and of character n-grams; sizes of an input and of a state.
WORDS, GRAMS, INPUT, STATE = 1 << 15, 1 << 15, 8, 8
GRAM_SIZES = (3, 4)
#: Labelled rows that training takes at most (those of smallest hash), and characters of text that they may hold together.
MAX_TRAIN_ROWS, MAX_TRAIN_CHARS = 3000, 40_000_000
EPOCHS, BATCH, RATE = 8, 128, 0.01
#: Documents that a bucket's first estimate is shrunk by.
PRIOR = 20
#: Windows that run at a time, and distinct words that a task remembers.
LANES, REMEMBER = 2048, 300_000
_MARKS = ".,;:!?\"'()[]{}#$%&*|-_"


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Lexicon:
    """Buckets of distinct tokens: ``word`` has one each; ``grams`` of token i start at ``start[i]``, ``size[i]`` of them."""

    def __init__(self, listed: list[str]):
        bare = [t.strip(_MARKS) or t for t in listed]
        self.word = np.fromiter((zlib.crc32(w.encode()) % WORDS for w in bare), np.int64, len(bare))
        codes = np.frombuffer("".join(f"<{w}>" for w in bare).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        length = np.array([len(w) + 2 for w in bare], np.int64)
        left = np.repeat(np.cumsum(length), length) - np.arange(len(codes))  # characters from here to the word's end
        of = np.repeat(np.arange(len(bare)), length)
        owners, grams = [], []
        for n in GRAM_SIZES:
            at = np.flatnonzero(left >= n)
            h = np.full(len(at), n, np.uint64)
            for k in range(n):
                h = (h ^ codes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            owners.append(of[at])
            grams.append((h % np.uint64(GRAMS)).astype(np.int64))
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        self.grams = np.concatenate(grams)[order]
        self.size = np.bincount(owner, minlength=len(bare))
        self.start = np.cumsum(self.size) - self.size

    def take(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word buckets, gram buckets, grams of each) of some tokens."""
        size = self.size[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.word[ids], self.grams[at], size


def windows(n: int) -> list[tuple[int, int]]:
    """Starts and ends of the overlapping windows that cover n words; the last one ends with the text."""
    if n <= WINDOW:
        return [(0, n)]
    starts = [*range(0, n - WINDOW, STRIDE), n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights and passes. ``p``: arrays by name; f and b are the two directions."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        draw = lambda *s, k=0.3: r.normal(0, k, s).astype(np.float32)
        self.p = {"words": draw(WORDS, INPUT, k=0.05), "grams": draw(GRAMS, INPUT, k=0.05)}
        for d in "fb":
            self.p |= {f"w{d}": draw(INPUT, 3 * STATE), f"u{d}": draw(STATE, 3 * STATE), f"c{d}": np.zeros(3 * STATE, np.float32)}
        self.p |= {"attend": draw(2 * STATE), "out": draw(2 * STATE), "bias": np.full(1, -1, np.float32)}

    def inputs(self, word: np.ndarray, grams: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The input vector of each distinct word."""
        if not len(word):
            return np.zeros((0, INPUT), np.float32)
        return self.p["words"][word] + np.maximum.reduceat(self.p["grams"][grams], np.cumsum(size) - size, axis=0)

    def project(self, x: np.ndarray) -> np.ndarray:
        """What both directions' gates take from the inputs: (words, 6 states)."""
        return np.concatenate([x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]], axis=1)

    def forward(self, gates: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. gates: projections by word; index, mask: (WINDOW, windows)."""
        p, (steps, n), s = self.p, index.shape, STATE
        full = bool(mask.all())
        states, trail = np.zeros((steps, n, 2 * s), np.float32), {"f": [], "b": []}
        for d, order, at in (("f", range(steps), 0), ("b", range(steps - 1, -1, -1), 3 * s)):
            u, h, mine = p[f"u{d}"], np.zeros((n, s), np.float32), np.ascontiguousarray(gates[:, at : at + 3 * s])
            for t in order:
                x, hu = mine[index[t]], h @ u
                zr = _sigmoid(x[:, : 2 * s] + hu[:, : 2 * s])
                z, r = zr[:, :s], zr[:, s:]
                c = np.tanh(x[:, 2 * s :] + r * hu[:, 2 * s :])
                new = c + z * (h - c)
                if not full:
                    new *= mask[t][:, None]
                if keep:
                    trail[d].append((t, h, z, r, c, hu[:, 2 * s :]))
                h = new
                states[t, :, (0 if d == "f" else s) : (s if d == "f" else 2 * s)] = h
        score = states @ p["attend"]
        if not full:
            score = np.where(mask > 0, score, -1e9)
        a = np.exp(score - score.max(axis=0))
        if not full:
            a *= mask
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnd->nd", a, states)
        logits = pooled @ p["out"] + p["bias"][0]
        return (logits, states, a, pooled, trail) if keep else logits

    def gradients(self, gates: np.ndarray, x: np.ndarray, index: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the mean logistic loss: by weight, and for the input vectors x of the batch's words."""
        p, s, n = self.p, STATE, index.shape[1]
        logits, states, a, pooled, trail = self.forward(gates, index, mask, keep=True)
        dl = ((_sigmoid(logits) - y) / n).astype(np.float32)
        g = {"out": pooled.T @ dl, "bias": np.array([dl.sum()], np.float32)}
        dpool = dl[:, None] * p["out"]
        da = np.einsum("nd,tnd->tn", dpool, states)
        dscore = a * (da - (a * da).sum(axis=0))
        g["attend"] = np.einsum("tn,tnd->d", dscore, states)
        dstates = a[:, :, None] * dpool[None] + dscore[:, :, None] * p["attend"]
        dgates = np.zeros_like(gates)
        for d, at, lo in (("f", 0, 0), ("b", 3 * s, s)):
            u, gu, dh = p[f"u{d}"], np.zeros_like(p[f"u{d}"]), np.zeros((n, s), np.float32)
            for t, h, z, r, c, hn in reversed(trail[d]):
                dh = (dh + dstates[t, :, lo : lo + s]) * mask[t][:, None]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * hn * r * (1 - r)
                dx = np.concatenate([dz, dr, dc], axis=1)
                dhu = np.concatenate([dz, dr, dc * r], axis=1)
                gu += h.T @ dhu
                np.add.at(dgates, (index[t], slice(at, at + 3 * s)), dx)
                dh = dh * z + dhu @ u.T
            g[f"u{d}"], g[f"c{d}"] = gu, dgates[:, at : at + 3 * s].sum(axis=0)
            g[f"w{d}"] = x.T @ dgates[:, at : at + 3 * s]
        return g, dgates[:, : 3 * s] @ p["wf"].T + dgates[:, 3 * s :] @ p["wb"].T


def _start_from_counts(net: Network, texts: list[np.ndarray], lexicon: Lexicon, labels: np.ndarray) -> None:
    """Put shrunk log-odds of each bucket's document counts into the first input, so that learning starts from evidence."""
    counts = {"words": np.zeros((2, WORDS)), "grams": np.zeros((2, GRAMS))}
    for ids, y in zip(texts, labels):
        word, grams, _ = lexicon.take(np.unique(ids))
        counts["words"][int(y)][np.unique(word)] += 1
        counts["grams"][int(y)][np.unique(grams)] += 1
    share = labels.mean()
    for name, (no, yes) in counts.items():
        rate = (yes + PRIOR * share) / (no + yes + PRIOR)
        net.p[name][:, 0] = np.log(rate / (1 - rate)) - np.log(share / (1 - share))


def train(rows: list[tuple[str | None, int]], epochs: int = EPOCHS, seed: int = 0) -> Network:
    """Fit the network to (text, 0 or 1) rows. Without rows of both labels it scores by the share of ones alone."""
    net = Network(seed)
    labels = np.array([y for _, y in rows], np.float32)
    if len(rows) == 0 or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(rows) + 1 if len(rows) else 2)
        net.p["out"][:] = 0
        net.p["bias"][0] = np.log(share / (1 - share))
        return net
    vocabulary: dict[str, int] = {}
    texts = [np.array([vocabulary.setdefault(t, len(vocabulary) + 1) for t in tokens(text)], np.int64) for text, _ in rows]
    lexicon = Lexicon(["", *vocabulary])  # place 0 fills windows up
    _start_from_counts(net, texts, lexicon, labels)
    spans = [(i, a, b) for i, t in enumerate(texts) for a, b in windows(len(t))]
    owner = np.array([i for i, _, _ in spans])
    index = np.zeros((WINDOW, len(spans)), np.int32)
    length = np.array([b - a for _, a, b in spans])
    for k, (i, a, b) in enumerate(spans):
        index[: b - a, k] = texts[i][a:b]
    mask = (np.arange(WINDOW)[:, None] < length).astype(np.float32)
    firsts = np.flatnonzero(np.diff(owner, prepend=-1))
    rng = np.random.default_rng(seed)
    memory = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0

    def logits_of_all() -> np.ndarray:
        gates = net.project(net.inputs(*lexicon.take(np.arange(len(lexicon.word)))))
        return np.concatenate([net.forward(gates, index[:, k : k + LANES], mask[:, k : k + LANES]) for k in range(0, len(spans), LANES)])

    for epoch in range(epochs):
        scores = logits_of_all()
        top = firsts + np.array([int(np.argmax(scores[a:b])) for a, b in zip(firsts, [*firsts[1:], len(spans)])])
        # Besides each text's highest window, one at random from each negative text.
        negative = np.flatnonzero(labels == 0)
        ends = np.append(firsts[1:], len(spans))
        more = firsts[negative] + (rng.random(len(negative)) * (ends - firsts)[negative]).astype(int)
        chosen = np.concatenate([top, more])
        targets = np.concatenate([labels, np.zeros(len(more), np.float32)])
        order = rng.permutation(len(chosen))
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            words, local = np.unique(index[:, chosen[pick]], return_inverse=True)
            local = local.reshape(WINDOW, -1)
            word, flat, sizes = lexicon.take(words)
            x = net.inputs(word, flat, sizes)
            g, dx = net.gradients(net.project(x), x, local, mask[:, chosen[pick]], targets[pick])
            step += 1
            rate = RATE * (1 - epoch / epochs) + RATE * 0.1
            for name, d in g.items():
                m, v = memory[name]
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                net.p[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            each = net.p["grams"][flat]
            most = np.maximum.reduceat(each, np.cumsum(sizes) - sizes, axis=0)
            dmost = np.repeat(dx, sizes, axis=0) * (each == np.repeat(most, sizes, axis=0))
            for name, where, d in (("words", word, dx), ("grams", flat, dmost)):
                rows_, inverse = np.unique(where, return_inverse=True)
                total = np.zeros((len(rows_), INPUT), np.float32)
                np.add.at(total, inverse, d)
                m, v = memory[name]
                v[rows_] += 0.1 * (total * total - v[rows_])
                net.p[name][rows_] -= rate * total / (np.sqrt(v[rows_] / 0.1) + 1e-6) * 0.3
    return net


def score_batches(net: Network, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row columns..., text) batches to the row columns and the highest window's probability."""
    gates, known = np.zeros((1, 6 * STATE), np.float32), {}
    within = np.arange(WINDOW)[:, None]
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        best = np.full(len(texts), -np.inf, np.float32)
        waiting: list[tuple[np.ndarray, np.ndarray, int]] = []
        lanes = 0

        def run() -> None:
            index = np.concatenate([ids for ids, _, _ in waiting], axis=1)
            length = np.concatenate([n for _, n, _ in waiting])
            owner = np.repeat([i for _, _, i in waiting], [len(n) for _, n, _ in waiting])
            for k in range(0, len(owner), LANES):
                part = slice(k, k + LANES)
                logits = net.forward(gates, index[:, part], (within < length[part]).astype(np.float32))
                np.maximum.at(best, owner[part], logits)

        for i, value in enumerate(texts):
            found = tokens(value.as_py())
            new = list({*found}.difference(known))
            if new:
                if len(known) + len(new) > REMEMBER and known:
                    if waiting:
                        run()
                        waiting, lanes = [], 0
                    known, gates = {}, gates[:1]
                    new = list({*found})
                known |= zip(new, range(len(known) + 1, len(known) + 1 + len(new)))
                lexicon = Lexicon(new)
                fresh = net.project(net.inputs(lexicon.word, lexicon.grams, lexicon.size))
                if len(known) >= len(gates):
                    gates = np.concatenate([gates, np.empty((max(len(known) + 1 - len(gates), len(gates)), gates.shape[1]), np.float32)])
                gates[len(known) + 1 - len(new) : len(known) + 1] = fresh
            n = len(found)
            ids = np.fromiter(map(known.__getitem__, found), np.int32, n)
            if n <= WINDOW:
                block = np.zeros((WINDOW, 1), np.int32)
                block[:n, 0] = ids
                waiting.append((block, np.array([n]), i))
            else:
                starts = np.array([a for a, _ in windows(n)])
                waiting.append((ids[starts[None, :] + within], np.full(len(starts), WINDOW), i))
            lanes += len(waiting[-1][1])
            if lanes >= LANES:
                run()
                waiting, lanes = [], 0
        if waiting:
            run()
        scores = _sigmoid(best.astype(np.float64))
        yield pa.record_batch([*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], "score"])


def training_rows(docs: DataFrame, labels: DataFrame, target: str, id_col: str, text_col: str, limit: int) -> list[tuple[str | None, int]]:
    """At most ``limit`` labelled rows, those whose id has the smallest hash; texts are whole."""
    known = labels.where(F.col(target).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(target).alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(limit)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows, held = [], 0
    for r in found.orderBy(F.xxhash64("id"), "id", "text").limit(limit).toLocalIterator():
        held += len(r["text"] or "")
        if rows and held > MAX_TRAIN_CHARS:
            break
        rows.append((r["text"], int(r["y"])))
    return rows


def held_out(id_col):
    """Whether an id belongs to the fold that training never sees."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "toxic", limit: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Train on labelled rows outside the held-out fold and score every row.

    Returns id, held_out, score (0 to 1) and predicted (1 from 0.5). Training takes at most ``limit`` rows and
    MAX_TRAIN_CHARS characters to the driver; scoring reads whole texts, and its memory is one batch, LANES windows and
    REMEMBER words. Null, empty and blank texts get the network's score of an empty window. A null id is held out: false.
    Without labels of both kinds every text gets the share of ones. Repeated rows give repeated results; repeated labels
    of an id count once, the larger one. Extra columns are ignored.
    """
    spark = docs.sparkSession
    usable = labels.where(~F.coalesce(held_out(F.col(id_col)), F.lit(True)))
    net = spark.sparkContext.broadcast(train(training_rows(docs, usable, target, id_col, text_col, limit)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(lambda batches: score_batches(net.value, batches), "id long, score double")
    return scored.select(
        F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
