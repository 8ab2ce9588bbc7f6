"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score into grades:
P(grade <= k) = sigmoid(threshold_k - score). The expected grade ranks texts, and the tail probability of reaching a grade
selects them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table, trimmed
from weftline.llm.toxicity import held_out, training_rows

BUCKETS = 1 << 16
#: Labelled rows that training takes at most, those of smallest hash.
MAX_TRAIN_ROWS = 6000
STEPS, RATE, DECAY = 150, 0.1, 1e-4
#: Scale of the mean feature counts.
SCALE = 10.0
#: Distinct words that a task remembers.
REMEMBER = 200_000
#: Probability of reaching the wanted grade from which a text is selected.
SELECT_FROM = 0.5


def shape(word: str) -> str:
    """Runs of lower-case letters, capitals and digits as one sign each, other characters as they are, runs once."""
    if word.isalpha() and word[1:].islower():
        return "a" if word[0].islower() else "Aa"
    signs = ("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "c" if c.isalpha() else c for c in word)
    return "".join(k for k, _ in groupby(signs))


def features(word: str) -> list[int]:
    """Buckets of a word: itself, its first and last characters, and its shape."""
    low = word.lower()
    return [zlib.crc32(f"{kind}{value}".encode()) % BUCKETS for kind, value in (("w", low), ("p", low[:3]), ("s", low[-3:]), ("h", shape(word)))]


def of_length(n: int) -> int:
    """Bucket of a text's number of words, by its power of two."""
    return zlib.crc32(f"n{n.bit_length()}".encode()) % BUCKETS


#: Bucket of the share of words that repeat the word before them.
REPEATS = zlib.crc32(b"r") % BUCKETS


def repeats(words: list[str]) -> int:
    return sum(map(eq, words, words[1:]))


@dataclass
class Ordinal:
    """``grades`` ascending; ``thresholds`` has one value less, ascending."""

    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for k = 1, 2, ...: (texts, grades - 1)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def train(rows: list[tuple[str | None, int]], steps: int = STEPS) -> Ordinal:
    """Maximum likelihood with a small ridge, by Adam over all rows at once. One grade or no rows: no thresholds."""
    grades = sorted({y for _, y in rows})
    if len(grades) < 2:
        return Ordinal(grades or [0], np.zeros(BUCKETS, np.float32), np.zeros(0))
    columns, values, starts = [], [], [0]
    known: dict[str, list[int]] = {}
    for text, _ in rows:
        listed = (text or "").split()
        words, n = Counter(listed), len(listed)
        x: Counter = Counter({of_length(n): 1 / SCALE})
        x[REPEATS] += repeats(listed) / max(1, n)
        for word, k in words.items():
            if word not in known:
                known[word] = features(word)
            for b in known[word]:
                x[b] += k / n
        columns.append(np.fromiter(x.keys(), np.int32, len(x)))
        values.append(np.fromiter(x.values(), np.float32, len(x)) * SCALE)
        starts.append(starts[-1] + len(x))
    del known
    column, value, start = np.concatenate(columns), np.concatenate(values), np.array(starts[:-1])
    row = np.repeat(np.arange(len(rows)), np.diff(starts))
    y = np.searchsorted(grades, [g for _, g in rows])
    share = np.cumsum(np.bincount(y, minlength=len(grades)))[:-1] / len(y)
    w = np.zeros(BUCKETS, np.float64)
    # Thresholds as a first value and positive gaps, so that they stay ordered.
    cuts = np.log(share / (1 - share))
    free = np.concatenate(([cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-3))))
    state = [np.zeros(BUCKETS + len(free)) for _ in range(2)]
    for step in range(1, steps + 1):
        gaps = np.exp(free[1:])
        cut = np.concatenate(([-np.inf], free[0] + np.concatenate(([0], np.cumsum(gaps))), [np.inf]))
        score = np.add.reduceat(value * w[column], start)
        upper, lower = (1 / (1 + np.exp(np.clip(score - c, -40, 40))) for c in (cut[y + 1], cut[y]))
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        dscore = (du - dl) / len(y)
        gw = np.bincount(column, value * dscore[row], BUCKETS) + DECAY * w
        gcut = (np.bincount(y, -du, len(grades))[:-1] + np.bincount(y, dl, len(grades))[1:]) / len(y)
        after = np.cumsum(gcut[::-1])[::-1]
        g = np.concatenate((gw, [after[0]], after[1:] * gaps))
        state[0] += 0.1 * (g - state[0])
        state[1] += 0.01 * (g * g - state[1])
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w -= move[:BUCKETS]
        free -= move[BUCKETS:]
    return Ordinal(grades, w.astype(np.float32), free[0] + np.concatenate(([0], np.cumsum(np.exp(free[1:])))))


def score_batches(model: Ordinal, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row columns..., text) batches to the row columns, the expected grade and the tail probabilities."""
    known: dict[str, float] = {}
    weights = model.weights
    for batch in batches:
        scores = []
        for value in batch.column(batch.num_columns - 1):
            words = (value.as_py() or "").split()
            total = 0.0
            for word in words:
                s = known.get(word)
                if s is None:
                    if len(known) >= REMEMBER:
                        known.clear()
                    s = known[word] = float(weights[features(word)].sum())
                total += s
            total += repeats(words) * float(weights[REPEATS])
            scores.append(SCALE * total / max(1, len(words)) + float(weights[of_length(len(words))]))
        tails = model.tails(np.array(scores, np.float64))
        expected = model.grades[0] + tails @ np.diff(model.grades)
        flat = pa.array(tails.reshape(-1))
        each = pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1) * tails.shape[1], pa.int32()), flat)
        yield pa.record_batch([*batch.columns[:-1], pa.array(expected, pa.float64()), each], names=[*batch.schema.names[:-1], "expected_grade", "tails"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "quality", limit: int = MAX_TRAIN_ROWS) -> Ordinal:
    """Train on at most ``limit`` labelled rows (those of smallest hash) outside the held-out fold."""
    usable = labels.where(~F.coalesce(held_out(F.col(id_col)), F.lit(True)))
    return train(training_rows(docs, usable, target, id_col, text_col, limit))


def grade(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text", at_least: int | None = None) -> DataFrame:
    """Score every whole text: id, expected_grade, tail_probability, kept.

    ``tail_probability`` is that of reaching ``at_least`` (default: the second lowest grade); from SELECT_FROM a text is
    kept. Null, empty and blank texts score by their length alone. Null ids are scored like others. A text of any length is split
    into words by one task, which holds them. Repeated rows give repeated results; extra columns are ignored; an empty table gives an
    empty result. A model of one grade gives everyone that grade and keeps them.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(lambda batches: score_batches(shared.value, batches), "id long, expected_grade double, tails array<double>")
    k = 0 if at_least is None else sum(g < at_least for g in model.grades) - 1
    if len(model.grades) < 2 or k < 0:
        tail = F.lit(1.0)
    elif k >= len(model.grades) - 1:
        tail = F.lit(0.0)
    else:
        tail = F.col("tails")[k]
    return scored.select(F.col("id").alias(id_col), "expected_grade", tail.alias("tail_probability"), (tail >= SELECT_FROM).alias("kept"))


def keep_good(docs: DataFrame, model: Ordinal, text_col: str = "text", at_least: int | None = None) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text is kept; decided row by row, so repeated and null ids don't mix.

    Texts of any length: as in ``grade``. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    k = 0 if at_least is None else sum(g < at_least for g in model.grades) - 1
    if len(model.grades) < 2 or k < 0:
        return docs
    if k >= len(model.grades) - 1:
        return docs.where(F.lit(False))
    at = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.record_batch([batch.column(at)], names=["text"])
            tails = next(score_batches(shared.value, iter([texts])))["tails"].values.to_numpy().reshape(len(texts), -1)
            yield batch.filter(pa.array(tails[:, k] >= SELECT_FROM))

    return docs.mapInArrow(trimmed(each), docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    graded = grade(docs, fit(docs, table(spark, sf_dir, "labels")))
    return graded.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", "kept")
