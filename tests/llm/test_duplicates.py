"""Exact, near and substring duplicates, benchmark passages."""

from __future__ import annotations

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import components, decontaminate, exact_dedup, simhash, suffix_dedup
from weftline.llm.common import Staged


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(spark, keep):
    r = random.Random(1)
    rows = [(r.choice([None, *range(100)]), r.choice([None, "", "a", "A", "Bc", "bC", "É", "é", "z" * 5000] + ["hot"] * 9), i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(lower(t), []).append(i)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    best = lambda ids: (max if keep == "max" else min)((i for i in ids if i is not None), default=None)
    got = exact_dedup.exact_dedup(docs, keep=keep, partitions=5).collect()
    assert len(got) == len(rows)
    assert all(g.keep_id == best(by_digest[g.text_sha256]) and g.group_size == len(by_digest[g.text_sha256]) for g in got)
    kept = [g for g in got if g.kept]
    assert sorted(g.text_sha256 for g in kept) == sorted(by_digest) and all(g.doc_id == g.keep_id for g in kept)
    left = exact_dedup.drop_copies(docs, keep=keep, partitions=5)
    assert left.columns == docs.columns
    assert sorted((lower(x.text), x.doc_id is None, x.doc_id or 0) for x in left.collect()) == sorted((t, best(ids) is None, best(ids) or 0) for t, ids in groups.items())


def test_exact_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def plain_fingerprint(text, n=3):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lower(text)).split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), seed=42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(1, 200))]
        for _ in range(r.randint(1, 5)):
            some = list(base)
            some[r.randrange(len(some))] = r.choice(words)
            rows.append((r.randrange(10_000), " ".join(some)))
    rows += [(20_000, None), (20_001, " \t"), (3, "One  two\x0bTHREE"), (4, "one two three"), (5, "x y"), (6, "é ü ö"), (7, "long " * 50_000), (4, "one two three")]
    got = simhash.near_duplicates(spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, fp string")).collect()
    fp = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if bin(fp[i] ^ fp[j]).count("1") <= 2:
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    want = sorted((i, f"{f:016x}", min(rows[k][0] for k in range(len(rows)) if group[k] == g)) for (i, _), f, g in zip(rows, fp, group))
    assert sorted(map(tuple, got)) == want
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_in_large_buckets(spark):
    """Near fingerprints beyond COARSE_LIMIT in one bucket take the fine keys and lose no link."""
    r = random.Random(3)
    base = r.getrandbits(64)
    values = {base ^ sum(1 << b for b in r.sample(range(20), r.randint(0, 5))) for _ in range(400)} | {r.getrandbits(64) for _ in range(200)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    got = {tuple(x) for x in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), Staged(spark)).collect()}
    full = (1 << 64) - 1
    assert got == {(a, b) for a, b in combinations(signed, 2) if bin((a ^ b) & full).count("1") <= 2}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, k) for k in range(501, 700)] + [(900, 900)]
    r = random.Random(0)
    r.shuffle(edges)
    got = {x.node: x.root for x in components.connect(spark.createDataFrame(edges, "a long, b long"), Staged(spark)).collect()}
    assert len({got[i] for i in range(101)}) == 1 and len({got[i] for i in range(500, 700)}) == 1 and got[900] == 900
    assert got[0] != got[500] and len(got) == 302


def test_similar_texts(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for g in range(12):
        base = [r.choice(words) for _ in range(120)]
        for k in range(6):
            some = list(base)
            for _ in range(k):
                some[r.randrange(len(some))] = r.choice(words)
            rows.append((g * 10 + k, " ".join(some)))
    rows += [(900, None), (901, ""), (None, rows[0][1]), (902, "a b"), (903, "A  b")]
    docs = spark.createDataFrame([(*x, "keep me") for x in rows], "doc_id long, text string, k1 string")
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * len(sets[i] | sets[j]):
            a, b = group[i], group[j]
            group = [a if x == b else x for x in group]
    want = sorted(min(rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None) for g in set(group))
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns and sorted(x.doc_id for x in left.collect()) == want
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


def linked_groups(sets):
    """Groups of sets linked at 0.8 by comparing all pairs, as sorted lists of places."""
    group = list(range(len(sets)))
    for i, j in combinations(range(len(sets)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = group[i], group[j]
            group = [a if x == b else x for x in group]
    return sorted([k for k in range(len(sets)) if group[k] == g] for g in set(group))


def groups_found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for x in simhash.similar_texts(docs).collect():
        found.setdefault(x.root, []).append(x.first_id)
    return sorted(sorted(v) for v in found.values())


def test_near_copies_in_a_template_family(spark):
    """Strangers that share a long passage fill every bucket; the few true pairs among them must still be found."""
    r = random.Random(7)
    some = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passage, other, texts = some(420), some(420), []
    for _ in range(300):
        texts.append(" ".join(passage + some(56)))
    for _ in range(20):
        own = some(56)
        texts += [" ".join(passage + own), " ".join(passage + own[:12] + some(44))]  # just above 0.8
    for _ in range(30):  # the passage with a word changed
        changed = list(passage)
        changed[r.randrange(len(passage))] = "other"
        texts.append(" ".join(changed + some(r.choice([53, 56]))))
    for n in [46, 50, *range(53, 113)]:  # linked over the passage alone, and only by way of a shorter text
        texts.append(" ".join(other + some(n)))
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    want = linked_groups(sets)
    assert sum(len(g) == 2 for g in want) >= 15 and max(map(len, want)) > 5 and sum(len(g) == 1 for g in want) > 200
    assert groups_found(spark, texts) == want


def test_near_copies_with_other_repetitions(spark):
    """Sets decide: a line repeated hundreds of times in one text turns its fingerprint, but not its set of shingles."""
    r = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"w{r.randrange(10**9)}" for _ in range(400)]
        texts += [" ".join(base), " ".join(base + base[:10] * 300), " ".join(base + base[200:210] * 300)]
    short = "a b c d e f g h"
    texts += [short, short + " i", "x y", "y x", "", " "]
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    far = [bin((simhash.fingerprint(a.encode(), 5) ^ simhash.fingerprint(b.encode(), 5)) & ((1 << 64) - 1)).count("1") for a, b in zip(texts[1:36:3], texts[2:36:3])]
    assert max(far) > 24
    want = linked_groups(sets[:-2]) + [[len(texts) - 2, len(texts) - 1]]  # blank texts are one group
    assert groups_found(spark, texts) == sorted(want)


def test_masks_hit_what_they_promise():
    def hit(n, bad):
        return any(all(o + x not in bad for x in m) for m in decontaminate.MASKS for o in range(n - m[-1]))

    assert all(hit(12, set(b)) for b in combinations(range(12), 2))
    assert all(hit(n, {b}) for n in (8, 9, 10, 11) for b in range(n))


def test_overlaps_against_all_alignments(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([5, 6, 7, 8, 9, 11, 12, 15, 30, 60, 4, 1])] + [(50, None), (51, ""), (None, "null item of exactly eight plain words here"), (7, "other words for the same number seven again")]
    docs = []
    for d in range(150):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        if d % 3:
            passage = r.choice(items[:12])[1].split()
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                passage[r.randrange(len(passage))] = "other"
            at = r.randint(0, len(words))
            words[at:at] = [w.upper() + "," for w in passage]
        docs.append((d, " ".join(words)))
    docs += [(1000, None), (1001, ""), (1002, "$$$ ### " * 3000), (None, items[8][1]), (3, docs[3][1])]
    got = {(x.doc_id, x.item_id): (x.matched_words, x.aligned_words) for x in decontaminate.overlaps(spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    hashed = decontaminate.Words()
    want = {}
    for d, t in docs:
        w = hashed(t)
        for i, u in items:
            b = hashed(u)
            if not len(b):
                continue
            for shift in range(-len(b) + 1, len(w)):
                if found := decontaminate.stretch_match(w, b, shift):
                    want[d, i] = max(want.get((d, i), (0, 0)), found[:2])
    assert got == want and len(want) > 40


def test_contaminated_rows_go(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine", "a"), (1, "clean", "b"), (None, None, "c")], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(1, "One two three four five six seven eight!")], "item_id long, text string")
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(x.lang for x in left.collect()) == ["b", "c"]
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == 3 and decontaminate.overlaps(docs.limit(0), bench).count() == 0


INTERNAL = ["_bad", "_k1", "_k2", "_id", "k1", "k2", "t1", "t2", "row", "id", "item", "node", "root", "size", "first_id", "c0", "c1", "words", "hits", "start"]


def test_columns_of_any_name_are_carried(spark):
    rows = [(1, "one two three four five six seven eight nine"), (2, "one two three four five six seven eight nine"), (3, "quite another text of more than five words"), (4, None)]
    docs = spark.createDataFrame([(*r, *range(len(INTERNAL))) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in INTERNAL))
    bench = spark.createDataFrame([(1, "one two three four five six seven eight", 5)], "item_id long, text string, id long")
    for left, want in ((simhash.drop_near_copies(docs), [1, 3, 4]), (decontaminate.drop_contaminated(docs, bench), [3, 4]), (exact_dedup.drop_copies(docs, keep="min"), [1, 3, 4])):
        assert left.columns == docs.columns
        assert sorted(map(tuple, left.collect())) == [(*rows[i - 1], *range(len(INTERNAL))) for i in want]


def test_merge_is_sorted_and_knows_prefixes():
    r = random.Random(0)
    for _ in range(200):
        runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 8))) for _ in range(r.randint(0, 6))]
        coded = [suffix_dedup.front_decode(suffix_dedup.front_code([(x, (0, 0, 1, 2, 3)) for x in run])) for run in runs]
        out = list(suffix_dedup.merge(coded))
        assert [x[0] for x in out] == sorted(sum(runs, []))
        assert all(b[1] == suffix_dedup.common_prefix(a[0], b[0]) for a, b in zip(out, out[1:]))


def plain_removal(rows):
    seen: dict[bytes, int] = {}
    for t in rows:
        for p in range(len(t) - 199):
            seen[t[p : p + 200]] = seen.get(t[p : p + 200], 0) + 1
    out = []
    for t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("size, hot", [(50_000, 50_000), (20, 50_000), (2000, 1), (300, 3)])
def test_removal_against_all_windows(spark, monkeypatch, size, hot):
    monkeypatch.setattr(suffix_dedup, "RANGE", size)  # many small ranges
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # anchors of more blocks go window by window
    monkeypatch.setattr(suffix_dedup, "COMPARE", size * 100)
    r = random.Random(size)
    base = ["".join(r.choice("abcdefgh ") for _ in range(1200)) for _ in range(5)]
    rows = []
    for i in range(80):
        t = ""
        for _ in range(r.randint(0, 4)):
            a, n = r.randrange(1000), r.randint(50, 600)
            t += r.choice(base)[a : a + n] + "é" * r.randint(0, 3)
        rows.append((i, t))
    rows += [(200, None), (201, ""), (202, "a" * 1000), (203, "ab" * 300), (204, "x" * 199), (205, "y" * 200), (206, "y" * 200), (None, rows[5][1]), (5, rows[5][1])]
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, first int")).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    want = [(i, *w) for (i, _), w in zip(rows, plain_removal([(t or "").encode() for _, t in rows]))]
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got), key=key) == sorted(want, key=key)


def test_windows_by_common_prefixes_alone():
    """Blocks around one anchor, against every pair of windows."""
    r = random.Random(1)
    anchor = bytes(r.choice(b"xyz") for _ in range(suffix_dedup.GRAM))
    for _ in range(20):
        lefts = [bytes(r.choice(b"ab") for _ in range(136)) for _ in range(3)]
        rights = [bytes(r.choice(b"ab") for _ in range(136)) for _ in range(3)]
        items = []
        for i in range(30):
            x, y = bytearray(r.choice(lefts)), bytearray(r.choice(rights))
            x[r.randrange(136)], y[r.randrange(136)] = b"cc"
            n = r.randint(0, 136)
            right = anchor + bytes(y)[: r.randint(136 - n, 136)]
            items.append((right + bytes(x)[len(x) - n :][::-1], (n, int(r.random() < 0.1), i, 0, 1000)))
        items.sort()
        shared = np.array([-1] + [suffix_dedup.common_prefix(a[0], b[0]) for a, b in zip(items, items[1:])])
        got = suffix_dedup.repeated_windows_of(shared, [s for s, _ in items], [x for _, x in items])
        seen = {}
        for i, (s, (n, twice, *_)) in enumerate(items):
            block = s[len(s) - n :][::-1] + s[: len(s) - n]
            for p in range(len(block) - 199):
                seen.setdefault((n - p, block[p : p + 200]), []).append((i, twice))
        want = np.zeros_like(got)
        for (d, _), owners in seen.items():
            if len(owners) + sum(t for _, t in owners) > 1:
                for i, _ in owners:
                    want[i, d] = True
        assert (got == want).all()


def test_removal_without_rows(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
