"""Hard negatives, the Jaccard join and the prefix trie against brute force on small tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftline.llm import hard_negatives as hn
from weftline.llm import jaccard_join as jj
from weftline.llm import prefix_trie as pt

# --- hard negatives


def brute_negatives(rows, percent=80, k=5):
    fine = [(i, a, b, [int(x) for x in v]) for i, a, b, v in rows if i is not None and a is not None and v is not None and None not in v]
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    out = []
    for n, (i, label, anchor, v) in enumerate(fine):
        if not anchor:
            continue
        others = sorted((-dot(v, w), j, m == label) for o, (j, m, _, w) in enumerate(fine) if o != n)
        for s, j, _ in [x for x in others if x[2]][:k]:
            found = [x for x in others if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(i, j, r, m, -s, -t) for r, (t, m, _) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(i, a, v, b, "x") for i, a, b, v in rows], "id long, label int, vector array<long>, flag boolean, part string")
    # `flag` isn't a column of the contract: the condition may use any of its input's columns.
    return sorted(map(tuple, hn.hard_negatives(df, F.col("flag")).collect()))


@pytest.mark.parametrize("seed,limits", [(1, {}), (2, {"BLOCK": 7, "PACK": 3, "HELD": 1, "PIVOTS": 4, "SAMPLE": 20}), (3, {"BLOCK": 5, "PACK": 2, "SAMPLE": 1})])
def test_hard_negatives_match_brute_force(spark, monkeypatch, seed, limits):
    for name, value in limits.items():
        monkeypatch.setattr(hn, name, value)
    r = random.Random(seed)
    middles = [[r.randrange(-300, 300) for _ in range(6)] for _ in range(5)]
    rows = [(i, r.randrange(3), r.random() < 0.2, [x + r.randrange(-40, 40) for x in r.choice(middles)]) for i in range(150)]
    rows += [(200 + i, 1, i == 3, list(middles[0])) for i in range(30)]  # many equal rows
    rows += [(5, 1, True, list(middles[1])), (5, 1, True, list(middles[1])), (5, 2, False, list(middles[2]))]  # repeated ids and rows
    rows += [(301, None, True, [1] * 6), (302, 1, True, None), (303, 1, True, [1, None, 2, 3, 4, 5]), (None, 1, True, [1] * 6), (304, 2, None, [9] * 6)]
    rows += [(305, 1, True, []), (306, 2, True, [7, 7]), (307, 9, True, [3] * 6), (308, 0, False, [100000] * 6)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_hard_negatives_of_large_numbers_are_exact(spark):
    r = random.Random(7)
    rows = [(i, i % 2, i < 4, [r.randrange(-(10**9), 10**9) for _ in range(4)]) for i in range(40)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_hard_negatives_of_an_empty_table_and_of_no_anchor(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, False, [1, 2]), (2, 2, False, [1, 2])]) == []


# --- Jaccard join


def shingles(text):
    words = (text or "").translate(str.maketrans(jj.UPPER, jj.LOWER)).encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for n, (i, _) in enumerate(docs):
        least[find(n)].append(i)
    return sorted(((i, len(sets[n]), min((x for x in least[find(n)] if x is not None), default=None)) for n, (i, _) in enumerate(docs)), key=str)


def family(r, size, words=120, changes=(0, 14), first=0):
    base = [f"w{r.randrange(1000)}" for _ in range(words)]
    out = []
    for i in range(size):
        own = list(base)
        for _ in range(r.randint(*changes)):
            own[r.randrange(words)] = f"x{r.randrange(10**6)}"
        out.append((first + i, " ".join(own)))
    return out


def joined(spark, docs):
    df = spark.createDataFrame([(i, t, 1, 2, 3, "y") for i, t in docs], "doc_id long, text string, node long, size long, id long, root string")
    return sorted(map(tuple, jj.jaccard_join(df).collect()), key=str)


@pytest.mark.parametrize("seed,limits", [(1, {}), (2, {"LEVELS": 1, "BITS": 32}), (3, {"VERIFY": 50.0, "THIN": 40})])
def test_jaccard_components_match_brute_force(spark, monkeypatch, seed, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jj, name, value)
    r = random.Random(seed)
    docs = [d for n in range(6) for d in family(r, 12, words=r.choice([8, 20, 60, 200]), changes=(0, r.choice([1, 3, 10])), first=100 * n)]
    docs += family(r, 40, words=150, changes=(0, 9), first=1000)
    licence = " ".join(f"l{i}" for i in range(60))
    docs += [(2000 + i, " ".join(f"z{r.randrange(10**6)}" for _ in range(r.choice([12, 14, 15, 16, 40]))) + " " + licence) for i in range(30)]
    docs += [(3000, None), (3001, ""), (3002, " \t\n "), (3003, "one two"), (3004, "One  TWO"), (3005, "one two three four five"), (3006, "É a b c d e"), (3007, "é a b c d e")]
    docs += [(3008, docs[0][1]), (50, docs[0][1].upper()), (0, docs[0][1]), (None, docs[30][1]), (None, "alone in the world with no id"), (3009, "a b c d e " * 5000)]
    r.shuffle(docs)
    assert joined(spark, docs) == brute_components(docs)


def test_sets_at_the_threshold(spark):
    """Of 4 to 60 shingles pairs that share exactly as many as a link needs, and one less."""
    docs, i = [], 0
    for n in range(4, 60, 5):
        for missing in (0, 1):
            share = -(-80 * 2 * n // 180) - missing
            words = [f"q{n}m{missing}w{k}" for k in range(n + 4)]
            docs += [(i, " ".join(words)), (i + 1, " ".join(words[: share + 4] + [f"o{n}m{missing}w{k}" for k in range(n - share)]))]
            i += 2
    assert joined(spark, docs) == brute_components(docs)


def test_jaccard_of_an_empty_table(spark):
    assert joined(spark, []) == []


# --- prefix trie


def brute_trie(turns, share):
    words = lambda t: len(t.encode().split())
    own = defaultdict(list)
    for c, at, role, text in turns:
        if c is not None:
            own[c].append((at is not None, at or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if share else 0
        built[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = []
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = lambda q: sum(len(p) == len(q) + 1 and p[: len(q)] == q for p in members)
        ended = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(path))))
        saved = sum((len(members[p]) - 1) * words(p[-1][1]) for p in below if p)
        parent = min(members[path[:-1]]) if path else None
        out.append((min(cs), len(path), parent, len(cs), kids(path), sum(kids(p) == 0 for p in below), saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, turns, share):
    df = spark.createDataFrame([(*t, 1, 2, 3) for t in turns], "conv_id long, turn long, role string, text string, c long, depth long, owner long")
    return sorted(map(tuple, pt.conversation_trie(df, share_heads=share).collect()), key=str)


@pytest.mark.parametrize("share", [False, True])
def test_trie_matches_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(pt, "_TEXT", 12)
    r = random.Random(5)
    turns = []
    for c in [*range(45), 60, 61, 75, 99]:
        shape = r.random()
        for t in range(r.randrange(1, 6)):
            turns.append((c, t, r.choice(["user", "assistant"]) if shape < 0.3 else "user", r.choice(["a b", "c", "d e f"]) if shape < 0.8 else "same words"))
    turns += [(3, None, None, None), (3, None, "user", ""), (4, 0, "user", "tie"), (4, 0, "user", "tie"), (4, 0, None, "tie"), (None, 1, "user", "lost"), (7, 1, "us", "era"), (8, 1, "user", "a")]
    turns += [(200, t, "user", f"deep {t} " * (3000 if t == 50 else 1)) for t in range(120)] + [(201, t, "user", f"deep {t} " * (3000 if t == 50 else 1)) for t in range(70)]
    r.shuffle(turns)
    assert trie(spark, turns, share) == brute_trie(turns, share)


def test_turnless_conversations_end_at_the_root(spark):
    """Conversations of one turn that take more than that from a block without a first one."""
    turns = [(c, 0, "user", "hello") for c in range(1, 20)]
    got = trie(spark, turns, True)
    assert got == brute_trie(turns, True)
    assert any(row[1] == 0 and row[3] == 19 for row in got)
    one = [(c, 0, "user", "hello") for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    assert len(trie(spark, one, True)) == 1


def test_trie_of_an_empty_table(spark):
    assert trie(spark, [], True) == []
