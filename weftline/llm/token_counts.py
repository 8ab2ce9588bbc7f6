"""Token counts of greedy longest-match word pieces by a linear automaton.

The vocabulary is a trie over bytes. Each node has a failure link to the node that stands for what is left after the pieces
that must be split off there, and the number of those pieces, computed once. Reading a word then takes one step for each byte,
never goes back, and builds no piece: only numbers are added up.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table

#: Distinct words that a task remembers, and the longest word (bytes) worth remembering.
REMEMBER, REMEMBER_BYTES = 300_000, 64


class LinearMatcher:
    """Counts of longest-match pieces. ``first``: pieces that start a word; ``inner``: pieces that go on within one.

    At every point the longest piece that fits is taken. A word that can't be cut in this way counts as one unknown piece.
    """

    def __init__(self, first: Iterable[bytes], inner: Iterable[bytes]):
        go: dict[int, int] = {}
        children: list[list[tuple[int, int]]] = [[], []]
        ends = [False, False]
        for root, pieces in ((0, first), (1, inner)):
            for piece in pieces:
                node = root
                for byte in piece:
                    at = node << 8 | byte
                    if at not in go:
                        go[at] = len(ends)
                        children[node].append((byte, len(ends)))
                        children.append([])
                        ends.append(False)
                    node = go[at]
                if piece:
                    ends[node] = True
        fail, popped = [-1] * len(ends), [0] * len(ends)
        todo = deque([0, 1])
        while todo:  # breadth first: shorter strings are ready before longer ones
            node = todo.popleft()
            for byte, child in children[node]:
                todo.append(child)
                if ends[child]:
                    fail[child], popped[child] = 1, 1
                    continue
                z, n = fail[node], popped[node]
                while z >= 0 and z << 8 | byte not in go:
                    n += popped[z]
                    z = fail[z]
                if z >= 0:
                    fail[child], popped[child] = go[z << 8 | byte], n
        self.go, self.fail, self.popped = go, fail, popped

    def count(self, word: bytes) -> int:
        """Number of pieces, 0 for an empty word, -1 if the word can't be cut."""
        if not word:
            return 0
        go, fail, popped = self.go, self.fail, self.popped
        node = total = 0
        for byte in word:
            at = go.get(node << 8 | byte)
            while at is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
                at = go.get(node << 8 | byte)
            node = at
        while node != 1:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return total


def byte_alphabet() -> dict[str, int]:
    """Characters that a byte-level vocabulary file writes for bytes: printable ones stand for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


def read_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a byte-level vocabulary file: those that start with a space begin words, those without any space go on."""
    alphabet = byte_alphabet()
    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    special = {t["content"] for t in described["added_tokens"]}
    pieces = [bytes(alphabet[c] for c in p) for p in described["model"]["vocab"] if p not in special]
    return [p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


def count_batches(matcher: LinearMatcher, prefix: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    for batch in batches:
        words, tokens, unknown = [], [], []
        for text in batch.column(1).cast(pa.binary()):
            found = (text.as_py() or b"").split()
            total = bad = 0
            for word in found:
                n = known.get(word)
                if n is None:
                    n = matcher.count(prefix + word)
                    if len(word) <= REMEMBER_BYTES:
                        if len(known) >= REMEMBER:
                            known.clear()
                        known[word] = n
                if n < 0:
                    bad += 1
                    n = 1
                total += n
            words.append(len(found))
            tokens.append(total)
            unknown.append(bad)
        yield pa.record_batch([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(unknown, pa.int64())], names=["id", "n_words", "n_tokens", "n_unknown"])


def count_tokens(docs: DataFrame, first: list[bytes], inner: list[bytes], id_col: str = "doc_id", text_col: str = "text", prefix: bytes = b" ") -> DataFrame:
    """id, n_words, n_tokens and n_unknown for every row.

    Words are the runs between ASCII white space of the whole text; each is read as ``prefix`` and its UTF-8 bytes. Null,
    empty and blank texts count zero. A word that the vocabulary can't cut counts one token and one unknown. Repeated rows
    give repeated results, null ids results of their own; extra columns are ignored; an empty table gives an empty result. A text
    of any length is split into words by one task, which holds them. The vocabulary's automaton is
    sent to the tasks: its size is the vocabulary's, not the data's.
    """
    matcher = docs.sparkSession.sparkContext.broadcast(LinearMatcher(first, inner))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(lambda batches: count_batches(matcher.value, prefix, batches), "id long, n_words long, n_tokens long, n_unknown long")
    return counted.withColumnRenamed("id", id_col)


def op7_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return count_tokens(table(spark, sf_dir, "documents"), *read_vocabulary(vocabulary))
