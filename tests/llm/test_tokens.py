"""Token counts, packing, the pipeline and the subpackage's place in the repository."""

from __future__ import annotations

import json
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from weftline.llm import decontaminate, exact_dedup, packing, quality, simhash, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
REPO = Path(__file__).resolve().parents[2]


def greedy(word, first, inner):
    n = at = 0
    while at < len(word):
        known = first if at == 0 else inner
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


def test_automaton_against_greedy_matching():
    r = random.Random(0)
    piece = lambda: bytes(r.choice(b"abc") for _ in range(r.randint(1, 4)))
    for _ in range(1500):
        first, inner = {piece() for _ in range(r.randint(0, 6))}, {piece() for _ in range(r.randint(0, 6))}
        matcher = token_counts.LinearMatcher(first, inner)
        for _ in range(15):
            word = bytes(r.choice(b"abc") for _ in range(r.randint(0, 9)))
            assert matcher.count(word) == greedy(word, first, inner), (first, inner, word)


def test_counts_of_a_public_vocabulary(spark):
    first, inner = token_counts.read_vocabulary(VOCABULARY)
    a, b = set(first), set(inner)
    texts = [None, "", " \t\n", "The unbelievable  naïve 𝒳 words", "x" * 2_000, "a " * 30_000, "The unbelievable  naïve 𝒳 words"]
    docs = spark.createDataFrame([(i if i else None, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts.count_tokens(docs, first, inner).collect()), key=lambda x: x[0] or 0)
    assert got == [(i if i else None, len((t or "").split()), sum(greedy(b" " + w.encode(), a, b) for w in (t or "").split()), 0) for i, t in enumerate(texts)]
    few = token_counts.count_tokens(spark.createDataFrame([(1, "ab zz ab")], "doc_id long, text string"), [b" a"], [b"b"]).collect()[0]
    assert tuple(few) == (1, 3, 5, 1)
    assert token_counts.count_tokens(docs.limit(0), first, inner).count() == 0


def fits(solution, counts, capacity):
    total = [0] * (capacity + 1)
    for filling, times in solution:
        assert sum(n * k for n, k in filling) <= capacity
        for n, k in filling:
            total[n] += k * times
    return total == list(counts) + [0] * (capacity + 1 - len(counts))


def fewest(pieces, capacity):
    """Bins of a best packing, by trying all."""
    best = len(pieces)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(pieces):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + pieces[i] <= capacity and bins[k] not in bins[:k]:
                place(i + 1, [*bins[:k], bins[k] + pieces[i], *bins[k + 1 :]])
        place(i + 1, [*bins, pieces[i]])

    place(0, [])
    return best


def test_bin_completion_is_near_the_best():
    r = random.Random(0)
    over = 0
    for _ in range(60):
        pieces = sorted((r.randint(1, 30) for _ in range(r.randint(0, 8))), reverse=True)
        counts = [pieces.count(n) for n in range(31)]
        solution = packing.complete_bins(counts, 30)
        assert fits(solution, counts, 30)
        best = fewest(pieces, 30)
        assert packing.lower_bound(counts, 30) <= best
        over += sum(t for _, t in solution) - best
    assert over <= 2
    counts = [0] + [r.randint(0, 5000) for _ in range(1024)]
    solution = packing.complete_bins(counts)
    assert fits(solution, counts, 1024) and sum(t for _, t in solution) <= packing.lower_bound(counts, 1024) * 1.005


def plain_best_fit(items, capacity):
    rooms = []
    for n in sorted(items, reverse=True):
        fitting = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fitting:
            rooms[min(fitting)[1]] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_bin_completion_is_never_worse_than_best_fit():
    r, better = random.Random(1), 0
    for _ in range(300):
        items = [r.randint(15, 60) for _ in range(r.randint(20, 60))]
        counts = [items.count(n) for n in range(101)]
        first, solution = packing.best_fit(counts, 100), packing.complete_bins(counts, 100)
        assert fits(first, counts, 100) and fits(solution, counts, 100)
        bins = sum(t for _, t in solution)
        assert sum(t for _, t in first) == plain_best_fit(items, 100) and packing.lower_bound(counts, 100) <= bins <= plain_best_fit(items, 100)
        better += bins < plain_best_fit(items, 100)
    assert better > 100


def test_bin_completion_finds_the_fewest_bins_of_small_instances():
    r = random.Random(2)
    for _ in range(200):
        items = [r.randint(3, 25) for _ in range(r.randint(1, 10))]
        assert sum(t for _, t in packing.complete_bins([items.count(n) for n in range(31)], 30)) == fewest(items, 30)


def test_dominated_fillings_are_left_out():
    found, _ = packing.fillings([0, 0, 1, 1, 0, 1, 0, 0, 0, 0], 7, 7, 7)
    assert found == [(0, ((5, 1), (2, 1)))]  # 3 + 2 wastes two, and 5 could stand for 3


def test_packing_holds_every_token(spark):
    r = random.Random(1)
    texts = [None, "", "x", "<|endoftext|> is text", "word " * 5000, "naïve 𝒳 " * 600, *(" ".join(r.choice(["alpha", "beta", "gamma,", "\n"]) for _ in range(r.randint(0, 900))) for _ in range(60))]
    docs = spark.createDataFrame([(i if i != 2 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, piece string")
    rows = packing.pack(docs.repartition(3), VOCABULARY).collect()
    slow = Tokenizer.from_file(VOCABULARY)
    by_doc = {}
    for x in rows:
        by_doc.setdefault(x.doc_id, []).append(x)
    assert set(by_doc) == {i if i != 2 else None for i in range(len(texts))}
    for i, t in enumerate(texts):
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[i if i != 2 else None], key=lambda x: x.piece)
        assert [x.piece for x in pieces] == list(range(len(pieces))) and sum(x.length for x in pieces) == len(ids)
        assert all(x.length == 1024 for x in pieces[1:]) and all(x.start == sum(y.length for y in pieces[:k]) for k, x in enumerate(pieces))
        assert all(x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes()) for x in pieces)
    sequences = {}
    for x in rows:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for held in sequences.values():
        held.sort()
        assert all(o == sum(n for _, n in held[:k]) for k, (o, _) in enumerate(held)) and sum(n for _, n in held) <= 1024
    counts = np.bincount([x.length for x in rows], minlength=1025).tolist()
    assert len(sequences) <= packing.lower_bound(counts, 1024) + 1
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0


def test_fast_ids_equal_the_library(spark):
    r, slow = random.Random(2), Tokenizer.from_file(VOCABULARY)
    fast = packing.Tokenizer(Path(VOCABULARY).read_text())
    pool = [chr(c) for c in [*range(0x3000), *range(0x1F300, 0x1F700)] if not 0xD800 <= c < 0xE000]
    for _ in range(1500):
        text = "".join(r.choice(pool) if r.random() < 0.4 else r.choice("ab \n\t's1,.'re  ") for _ in range(40))
        assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Made documents of each kind meet their fate in the stage that is theirs."""
    r = random.Random(3)
    words = [f"word{i}" for i in range(500)]
    text = lambda n=60: " ".join(r.choice(words) for _ in range(n))
    good = [text() for _ in range(120)]
    junk = [" ".join(w + "%%%" for w in text().split()) for _ in range(60)]
    near = good[3].split()
    near[30] = "changed"
    passage = text(20)
    rows = [*good, *junk, good[0].upper(), " ".join(near), text(30) + " " + passage + " " + text(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, now = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        left.append({x.doc_id for x in now.select("doc_id").collect()})
    everything = set(range(len(rows)))
    assert left[0] == everything - set(range(120, 180))
    assert left[1] == left[0] - {0}  # the upper-case copy has the larger id
    assert left[2] == left[1] - {181}
    assert left[3] == left[2] - {182} == left[4]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in whole.select("doc_id").collect()} == left[4]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]


def test_pipeline_without_labels_or_benchmark(spark, tmp_path):
    """Without labels nobody is rejected, without a benchmark nobody is contaminated; empty documents give an empty result."""
    rows = [(1, "one two three four five six"), (2, "ONE two three four five six"), (3, ""), (4, None), (None, "seven eight nine ten eleven twelve")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, some, want in (("all", docs, {2, 4, None}), ("none", docs.limit(0), set())):
        some.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {x.doc_id for x in got} == want


def test_stages_take_nulls_and_empty_tables(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a " * 20_000, "en", "s", 40_000)], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(None, None)], "item_id long, text string")
    model = quality.train([("a", 0), ("b", 1)])
    for docs in (odd, odd.limit(0)):
        for out in (quality.keep_good(docs, model), exact_dedup.drop_copies(docs), simhash.drop_near_copies(docs), decontaminate.drop_contaminated(docs, bench)):
            assert out.columns == docs.columns and out.count() <= docs.count()
    assert exact_dedup.drop_copies(odd).count() == 2


def test_rest_works_without_the_subpackage(tmp_path):
    """The entry imports and lists its other queries in a copy without llm, its tests and the pipeline."""
    for part in ("weftline", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(REPO / part), str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "weftline/llm")], check=True)
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    queries, sql = json.loads(run.stdout.splitlines()[-1])
    assert queries and not [q for q in queries if re.match(r"op\d+_", q) or q == "pipeline"] and set(sql) <= set(queries)


def test_nothing_else_imports_the_subpackage():
    for path in (REPO / "weftline").rglob("*.py"):
        if "llm" not in path.parts:
            assert "weftline.llm" not in path.read_text(), path
