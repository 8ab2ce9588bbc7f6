"""URL rules, quality, toxicity, personal data."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import pii, quality, toxicity, url_filter


def rules(spark):
    return spark.createDataFrame(url_filter.RULES, url_filter.RULE_SCHEMA)


def test_url_rules(spark):
    urls = [
        ("http://a.example.org/es/x", "block", "example.org/es/"),
        ("HTTPS://EXAMPLE.ORG/en/12?q", "block", "example.org/en/1"),
        ("http://x.org/", "allow", "org/"),
        ("http://x.org", "allow", None),
        ("http://notexample.org/es/", "allow", "org/"),
        ("ftp://shop.com/de/#f", "block", "com/de/"),
        (None, "allow", None),
        ("no scheme", "allow", None),
        ("http://" + "a." * 300 + "com/de/" + "x" * 20000, "block", "com/de/"),
    ]
    rows = [(i, u, "clash", "clash") for i, (u, _, _) in enumerate(urls)] + [(None, urls[0][0], "", ""), (3, urls[3][0], "", "")]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, verdict string"), rules(spark)).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: (r.verdict, r.rule) for r in got}
    assert all(by_id[i] == (v, rule) for i, (_, v, rule) in enumerate(urls)) and by_id[None] == ("block", "example.org/es/")


def test_url_rules_of_equal_length(spark):
    """Block wins, then the smaller text; rules of one text and different verdicts are a tie, too."""
    ties = [("org", "/aaaaaaaaa/", "allow"), ("a.example.org", "/", "allow"), ("com", "/xx/", "allow"), ("x.com", "/x", "block"), ("net", "/", "allow"), ("net", "/", "block"), (None, "/", "block"), ("de", None, "block")]
    urls = ["http://a.example.org/aaaaaaaaa/b", "http://x.com/xx/y", "http://a.net/", "http://b.de", "http://" + "a." * 20000 + "net/"]
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(ties, url_filter.RULE_SCHEMA)).orderBy("page_id").collect()
    assert [(x.rule, x.verdict) for x in got] == [("a.example.org/", "allow"), ("x.com/x", "block"), ("net/", "block"), ("de", "block"), ("net/", "block")]


def test_url_rules_without_rows(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(empty, rules(spark)).count() == 0
    some = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filter.filter_urls(some, rules(spark).limit(0)).collect()[0].verdict == "allow"


def graded(n=240, seed=0):
    r = random.Random(seed)
    words = {0: ["bad", "junk$$$", "XX"], 1: ["fair", "so"], 2: ["good", "fine"], 3: ["best", "great"]}
    return [(" ".join(r.choice(words[g] + ["the", "of", "and"]) for _ in range(30)), g) for g in (r.randrange(4) for _ in range(n))]


def test_ordinal_regression_orders_grades():
    model = quality.train(graded())
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    test = graded(seed=1)
    out = next(quality.score_batches(model, iter([pa.record_batch([pa.array([t for t, _ in test])], names=["text"])])))
    expected = out["expected_grade"].to_numpy()
    assert np.mean(np.round(expected) == [g for _, g in test]) > 0.95
    tails = out["tails"].values.to_numpy().reshape(-1, 3)
    assert (np.diff(tails, axis=1) <= 1e-9).all()


def test_quality_edges(spark):
    model = quality.train(graded())
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "good fine " * 20000, "z"), (3, "good fine best", "w"), (3, "good fine best", "w")], "doc_id long, text string, tails string")
    assert quality.grade(docs, model, at_least=2).count() == 5
    kept = quality.keep_good(docs, model, at_least=2)
    assert kept.columns == docs.columns and kept.where("doc_id = 3").count() == 2
    assert quality.grade(docs.limit(0), model).count() == 0
    assert quality.grade(docs, quality.train([("a", 1)])).where("kept").count() == 5
    assert quality.grade(docs, quality.train([])).count() == 5


def insults(n, seed):
    r = random.Random(seed)
    plain = ["".join(r.choice("aeiou") + r.choice("lmnrst") for _ in range(r.randint(1, 3))) for _ in range(300)]
    rows = []
    for _ in range(n):
        words = [r.choice(plain) for _ in range(r.randint(5, 150))]
        bad = r.random() < 0.3
        if bad:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["idiot", "scum.", "zq" + r.choice(plain)])
        rows.append((" ".join(words), int(bad)))
    return rows


def test_network_learns_words_and_their_letters():
    r = random.Random(0)
    rows = insults(900, 0)
    net = toxicity.train(rows[:800])
    test = rows[800:]
    out = next(toxicity.score_batches(net, iter([pa.record_batch([pa.array(range(100)), pa.array([t for t, _ in test])], names=["id", "text"])])))
    right = (out["score"].to_numpy() >= 0.5) == (np.array([y for _, y in test]) == 1)
    assert right.mean() > 0.9
    # One bad word far into a long text is found, as all windows are scored.
    clean = [t for t, y in rows if not y]
    long = " ".join(r.choice(clean) for _ in range(60))
    scores = [next(toxicity.score_batches(net, iter([pa.record_batch([pa.array([0]), pa.array([t])], names=["id", "text"])])))["score"][0].as_py() for t in (long, long + " idiot scum idiot " + clean[0])]
    assert scores[0] < 0.5 < scores[1]


def test_gradients_match_differences():
    net, rng = toxicity.Network(1), np.random.default_rng(0)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x, index = rng.normal(0, 1, (5, toxicity.INPUT)), rng.integers(0, 5, (toxicity.WINDOW, 3))
    mask = (np.arange(toxicity.WINDOW)[:, None] < np.array([32, 7, 1])).astype(np.float64)
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.forward(net.project(x), index, mask)
        return float(np.mean(np.log1p(np.exp(-z * (2 * y - 1)))))

    g, dx = net.gradients(net.project(x), x, index, mask, y)
    for name, where in (("uf", (1, 2)), ("ub", (0, 20)), ("wf", (3, 9)), ("wb", (2, 4)), ("attend", (5,)), ("out", (9,)), ("cb", (7,))):
        at = net.p[name][where]
        net.p[name][where] = at + 1e-3
        up = loss()
        net.p[name][where] = at - 1e-3
        down = loss()
        net.p[name][where] = at
        assert g[name][where] == pytest.approx((up - down) / 2e-3, abs=2e-4), name


def test_windows_cover_everything():
    for n in (0, 1, 32, 33, 48, 49, 100, 1000):
        spans = toxicity.windows(n)
        assert set().union(*(range(a, b) for a, b in spans)) == set(range(n)) and all(b - a <= toxicity.WINDOW for a, b in spans)


def test_toxicity_edges(spark):
    rows = [(i, t) for i, (t, _) in enumerate(insults(60, 2))] + [(100, None), (101, ""), (None, "idiot"), (102, "word " * 30000), (5, "again")]
    labels = spark.createDataFrame([(i, y, 0) for i, (_, y) in enumerate(insults(60, 2))] + [(0, None, 0), (None, 1, 0)], "doc_id long, toxic int, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.score_toxicity(docs, labels.limit(0)).count() == len(rows)


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, value):
    d = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


def test_base_spans_against_plain_search(spark):
    r = random.Random(3)
    bits = ["a@b.c", "%", "1", "22", ".", "-", " ", "@", "+", "4111 1111 1111 1111", "x", "é", "𝒳", "\x01", "(", "0.0.0.0", "999", "mail", "com", "+1 (043) 555-1234", "\n"]
    docs = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for i in range(600)]
    docs += [(1000, None), (1001, ""), (1002, "1" * 30000), (1003, "a" * 30000 + "@x.y"), (1004, "1.2.3.4 " * 500), (None, "a@b.c"), (0, docs[0][1])]
    got = pii.find_personal_data(spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, spans string")).collect()
    assert len(got) == len(docs)
    by_id = {g.doc_id: g for g in got}
    for i, t in docs:
        want = base(t)
        assert by_id[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), (i, t)
        assert [by_id[i][f"n_{k}"] for k in KINDS] == [sum(w[0] == k for w in want) for k in KINDS]
        assert set(f"{k}:{a}:{b}" for k, a, b in want) <= set(by_id[i].spans.split(","))


def test_classifier_adds_spelled_out_data(spark):
    texts = [f"please contact me: name{i}@mail.example.com or call +1 (043) 555-12{i:02d}, thanks" for i in range(40)]
    texts += [f'token = "{i}a555-123-4567b"' for i in range(40)]
    texts += [f"you can call me on 555-123-45{i:02d} or mail john{i} at mail dot com, Dr. John Smith" for i in range(30)]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i].n_added >= 2 and "phone:19:31" in got[i].spans for i in range(80, 110))
    assert sum(got[i].n_added for i in range(40, 80)) == 0
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimation_separates_reliable_labelers():
    counts = [(0, (1, 1, 1, 1), 80), (0, (1, 1, 0, 1), 40), (0, (-1, 0, -1, -1), 90), (0, (-1, 1, 0, -1), 30), (0, (1, 0, 0, 1), 20)]
    belief = pii.estimate(counts)
    assert belief[0, (1, 1, 1, 1)] > 0.95 and belief[0, (-1, 0, -1, -1)] < 0.05


def plain_labels(text, kind, a, b):
    """(votes, features) of a span by plain search."""
    value, before, after = text[a:b], text[max(0, a - 30) : a], text[b : b + 1]
    votes = (
        1 if re.search(pii.FORMATS[kind], value) else -1,
        1 if re.search(pii.GAZETTEERS[kind], value) else 0,
        1 if re.search(pii.ABOUT, before) else -1 if re.search(pii.AGAINST, before) else 0,
        1 if not re.search("[A-Za-z0-9]$", before) and not re.search("^[A-Za-z0-9]", after) else -1,
    )
    shape = re.sub("[0-9]+", "0", re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", value)))
    word = re.search(r"([^\W\d_]+)[\W\d_]*$", before)
    near = re.sub("[0-9]", "0", re.sub(r"[^\W\d_]", "a", before[-2:]))
    told = [("kind", ""), ("shape", shape), ("word", word.group(1).lower() if word else ""), ("next", re.sub(r"[^\W\d_]", "a", after)), ("near", near), ("size", len(value)), ("first", value[:2])]
    return votes, frozenset((name, kind, v) for name, v in told)


def plain_belief(votes):
    """Expectation-maximisation written out over single spans."""
    belief = [1 / (1 + np.exp(-1.5 * sum(v))) for _, v in votes]
    for _ in range(pii.ROUNDS):
        share = {k: (1 + sum(p for (j, _), p in zip(votes, belief) if j == k), 2 + sum(j == k for j, _ in votes)) for k, _ in votes}
        rate = {}
        for j in range(pii.LABELERS):
            for truth in (0, 1):
                table = {v: 1.0 + (2.0 if v == (1 if truth else -1) else 0) for v in (-1, 0, 1)}
                for (_, v), p in zip(votes, belief):
                    table[v[j]] += p if truth else 1 - p
                for v, n in table.items():
                    rate[j, truth, v] = n / sum(table.values())
        odds = [np.log(share[k][0] / (share[k][1] - share[k][0])) + sum(np.log(rate[j, 1, x] / rate[j, 0, x]) for j, x in enumerate(v)) for k, v in votes]
        belief = [1 / (1 + np.exp(-np.clip(o, -30, 30))) for o in odds]
    return np.array(belief)


def test_added_spans_against_plain_votes_estimation_and_regression(spark):
    r = random.Random(6)
    parts = ["call {0} now", "version {0}", "tel: {0}.", "hash {0}x", "Dr. Maria Lopez said", "ssn 123-45-67{1}", "page 123-45-67{1}", "api_key = 'a8f{1}b2c3d4e5f6'", "token: build", "john(at)mail.com", "mail me: a{1}@b.com", "id=AKIAABCDEFGH1234567{1}"]
    texts = [" ".join(r.choice(parts).format(f"555-{r.randint(200, 999)}-{r.randint(1000, 9999)}", r.randint(10, 99)) for _ in range(r.randint(1, 4))) for _ in range(120)]
    spans, votes, features = [], [], []
    for i, t in enumerate(texts):
        found = base(t)
        wide = [(k, m.start(), m.end()) for k, p in pii.WIDER.items() for m in re.finditer(p, t)]
        for here, spans_ in ((True, found), (False, [w for w in wide if not any(a < w[2] and w[1] < b for _, a, b in found)])):
            for k, a, b in spans_:
                v, f = plain_labels(t, k, a, b)
                spans.append((i, here, f"{k}:{a}:{b}"))
                votes.append((k, v))
                features.append(f)
    p = plain_belief(votes)
    names = sorted({f for fs in features for f in fs}, key=str)
    x = np.array([[1.0] + [n in fs for n in names] for fs in features], float)
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-12] + [pii.RIDGE] * len(names))
    for _ in range(60):  # Newton's steps
        q = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) / len(x) + ridge + 1e-9 * np.eye(len(w)), x.T @ (q - p) / len(x) + ridge @ w)
    q = 1 / (1 + np.exp(-x @ w))
    sure = np.abs(q - pii.ACCEPT) > 0.03
    got = {g.doc_id: g for g in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for (i, here, span), s, chance in zip(spans, sure, q):
        if here or s:
            assert (span in got[i].spans.split(",")) == (here or chance > pii.ACCEPT), (texts[i], span, chance)
    assert sum(sure) > 0.9 * len(sure) and 20 < sum(g.n_added for g in got.values()) < len(spans) - 20
    assert all(g.n_spans == len([s for s in g.spans.split(",") if s]) for g in got.values())


def test_very_many_spans_take_linear_time(spark):
    text = " ".join(f"a{i}@mail.example.com" for i in range(20_000))
    got = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert got.n_email == 20_000 and got.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base(text)).encode()).hexdigest()


def plain_score(net, text):
    """The highest window's probability, window by window, step by step and word by word."""
    p, s = net.p, toxicity.STATE
    sig = lambda v: 1 / (1 + np.exp(-np.asarray(v, np.float64)))
    words = toxicity.tokens(text)

    def vector(word):
        bucket, grams, _ = toxicity.Lexicon([word]).take(np.array([0]))
        return p["words"][bucket[0]].astype(np.float64) + np.max([p["grams"][g] for g in grams], axis=0)

    best = -np.inf
    for a, b in toxicity.windows(len(words)):
        xs = [vector(w) for w in words[a:b]]
        states = {}
        for d, order in (("f", range(b - a)), ("b", range(b - a - 1, -1, -1))):
            h = np.zeros(s)
            for t in order:
                x, u = xs[t] @ p[f"w{d}"] + p[f"c{d}"], h @ p[f"u{d}"]
                z, r = sig(x[:s] + u[:s]), sig(x[s : 2 * s] + u[s : 2 * s])
                h = (1 - z) * np.tanh(x[2 * s :] + r * u[2 * s :]) + z * h
                states[d, t] = h
        both = [np.concatenate([states["f", t], states["b", t]]) for t in range(b - a)]
        if both:
            e = np.exp([v @ p["attend"] - max(w @ p["attend"] for w in both) for v in both])
            pooled = sum(k * v for k, v in zip(e / e.sum(), both))
        else:
            pooled = np.zeros(2 * s)
        best = max(best, pooled @ p["out"] + p["bias"][0])
    return sig(best)


def test_scores_match_a_plain_pass_over_each_window(monkeypatch):
    monkeypatch.setattr(toxicity, "LANES", 5)  # windows of several texts in one pass, long texts over several
    monkeypatch.setattr(toxicity, "REMEMBER", 30)  # words are forgotten and learnt again
    r, net = random.Random(4), toxicity.Network(3)
    texts = [" ".join(f"w{r.randrange(40)}" for _ in range(n)) for n in (1, 2, toxicity.WINDOW - 1, toxicity.WINDOW, toxicity.WINDOW + 1, 150, 3, 90)] + ["", None, " \n", "É!! x" * 3]
    got = next(toxicity.score_batches(net, iter([pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])])))["score"].to_pylist()
    assert got == pytest.approx([plain_score(net, t) for t in texts], abs=1e-5)


def plain_features(text):
    words = (text or "").split()
    x = {quality.of_length(len(words)): 1 / quality.SCALE, quality.REPEATS: quality.repeats(words) / max(1, len(words))}
    for w in words:
        for b in quality.features(w):
            x[b] = x.get(b, 0) + 1 / len(words)
    return {b: v * quality.SCALE for b, v in x.items()}


def plain_objective(rows, grades, weights, thresholds):
    """Mean negative log-likelihood of the grades under the cumulative link, and the ridge."""
    total = 0.0
    for text, y in rows:
        s = sum(v * weights.get(b, 0.0) for b, v in plain_features(text).items())
        below = [0.0, *(1 / (1 + np.exp(s - c)) for c in thresholds), 1.0]
        k = grades.index(y)
        total -= np.log(max(below[k + 1] - below[k], 1e-12))
    return total / len(rows) + quality.DECAY / 2 * sum(w * w for w in weights.values())


def test_training_reaches_the_optimum_of_the_plain_objective(monkeypatch):
    monkeypatch.setattr(quality, "RATE", 0.002)  # small steps settle; with the usual ones the weights still swing a little
    r = random.Random(6)
    words = ["good", "fine", "plain", "bad", "junk"]
    rows = [(" ".join(r.choices(words, weights=[3 - g + 1, 2, 2, g + 1, g * 2 + 1], k=r.randrange(1, 12))), 3 - g) for g in (0, 1, 2, 3) for _ in range(12)]
    model = quality.train(rows, steps=8000)
    used = sorted({b for t, _ in rows for b in plain_features(t)})
    weights, cuts = {b: float(model.weights[b]) for b in used}, list(model.thresholds)
    assert model.grades == [0, 1, 2, 3] and cuts == sorted(cuts)
    base = plain_objective(rows, model.grades, weights, cuts)
    step = 1e-4
    slopes = [(plain_objective(rows, model.grades, weights | {b: weights[b] + step}, cuts) - plain_objective(rows, model.grades, weights | {b: weights[b] - step}, cuts)) / (2 * step) for b in used]
    for k in range(3):
        more, less = ([c + (d if i == k else 0) for i, c in enumerate(cuts)] for d in (step, -step))
        slopes.append((plain_objective(rows, model.grades, weights, more) - plain_objective(rows, model.grades, weights, less)) / (2 * step))
    assert max(map(abs, slopes)) < 5e-3
    assert base < plain_objective(rows, model.grades, dict.fromkeys(used, 0.0), cuts) - 0.1
    out = next(quality.score_batches(model, iter([pa.record_batch([pa.array([t for t, _ in rows])], names=["text"])])))
    for (text, _), expected, tails in zip(rows, out["expected_grade"].to_pylist(), out["tails"].to_pylist()):
        s = sum(v * weights[b] for b, v in plain_features(text).items())
        want = [1 / (1 + np.exp(c - s)) for c in cuts]
        assert tails == pytest.approx(want, abs=1e-4) and expected == pytest.approx(sum(want), abs=1e-3)
