"""Personal data by weak supervision, with built-in functions alone.

Four kinds have exact base rules. Besides, a wider set of candidate spans gets votes from four labelers: the format of the
span, gazetteers, the words before it, and its boundaries. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is and how likely each pattern is personal data; these soft labels train a classifier, a
logistic regression over features of the span and its surroundings, which decides the candidates. Base spans always stay, and
accepted candidates that overlap none of them are added.

One pass over the texts makes each document's spans and candidates; everything after reads only these. The regression is
Spark's own, over the distinct feature patterns with their summed labels as weights, so its input doesn't grow with repeats.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Staged, table

#: Stands around matches; where a text has it, another control character takes its place for matching.
_SIGN, _OTHER = "\x01", "\x02"
KINDS = ["email", "ip", "card", "phone"]
#: Base rules in a form that never backtracks into a run: a match starts at its run's start or where the last one ended.
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a rule to be tried at all.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){12}", "phone": r"\+[0-9]"}

#: Gazetteers and context words of the labelers. Fixed values.
GIVEN_NAMES = (
    "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|David|Elizabeth|William|Barbara|Richard|Susan|Joseph|Jessica|Thomas|Sarah|Charles|Karen|"
    "Christopher|Lisa|Daniel|Nancy|Matthew|Betty|Anthony|Sandra|Mark|Margaret|Donald|Ashley|Steven|Kimberly|Andrew|Emily|Paul|Donna|Joshua|Michelle|"
    "Kenneth|Carol|Kevin|Amanda|Brian|Melissa|George|Deborah|Timothy|Stephanie|Ronald|Rebecca|Jason|Laura|Edward|Helen|Jeffrey|Sharon|Ryan|Cynthia|"
    "Anna|Peter|Hans|Klaus|Stefan|Andreas|Wolfgang|Ursula|Monika|Petra|Sabine|Renate|Heike|Martin|Lukas|Leon|Lena|Mia|Julia|Katharina|"
    "Pierre|Jean|Marie|Jacques|Michel|Camille|Louis|Nathalie|Isabelle|Sylvie|Nicolas|Julien|Claire|Lucas|Emma|Chantal|Antoine|Philippe|Monique|Alain|"
    "Carlos|Jose|Luis|Sofia|Maria|Ana|Juan|Carmen|Pedro|Lucia|Miguel|Javier|Elena|Pablo|Isabel|Manuel|Francisco|Rosa|Diego|Teresa"
)
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Don|Sr|Sra"
DOMAINS = "com|org|net|edu|gov|info|io|co|biz|dev|app|de|fr|es|uk|eu|us|ca|au|ch|at|it|nl|be|pl|se|pt|ie|dk|no|fi|br|mx|in|jp"
#: Openings of issued keys, and names under which secrets are assigned.
ISSUED = "AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|xox[abp]-|sk-|sk_live_|pk_live_|AIza|eyJ"
ASSIGNED = "pass(?:word|wd|phrase)|secret|api[_-]?key|access[_-]?key|(?:auth|access)[_-]?token|credential"
ABOUT = r"(?i)\b(?:e-?mail|mail|contact|call|phone|tel|telephone|mobile|fax|reach|ssn|social security|iban|account|konto|cuenta|compte|card|name|named|dear|signed|address|password|secret|credential|login)\b[^\n]{0,20}$"
AGAINST = r"(?i)(?:\b(?:token|hash|sha|md5|uuid|version|isbn|issn|build|commit|figure|table|page|key)\b|[$€£=\"])[^\n]{0,10}$"
#: Wider candidates by kind: spelled-out addresses, national phone numbers, and kinds that have no base rule.
WIDER = {
    "email": r"[A-Za-z0-9._%+-]{2,40}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{2,40}(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z]{2,12}){1,3}+",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": rf"(?=[acegpsxACPS])(?<![A-Za-z0-9])(?:(?:{ISSUED})[A-Za-z0-9_./+-]{{12,}}+|(?i:{ASSIGNED})[\"']?\x20?[=:]\x20?[\"']?[A-Za-z0-9_./+-]{{8,}}+)",
    "name": rf"(?=[A-Z])(?<![A-Za-z])(?:(?:{TITLES})\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?|(?:{GIVEN_NAMES})\x20[A-Z][a-z]+)(?![A-Za-z])",
}
WIDER_GUARDS = {
    "email": r"(?:\(at\)|\[at\]|\x20at\x20)[^\n]{2,42}(?:dot|\.)",
    "phone": r"[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
    "secret": rf"(?=[AgxspPe])(?:{ISSUED})[A-Za-z0-9_./+-]{{12}}|(?=[acpsACPS])(?i:{ASSIGNED})[\"']?\x20?[=:]",
    "name": rf"(?=[A-Z])(?:{TITLES}|{GIVEN_NAMES})\.?\x20[A-Z][a-z]",
}
FORMATS = {
    "email": rf"(?i)(?:@|at\W).*(?:\.|dot\W?\s?)(?:{DOMAINS})\s*$",
    "ip": rf"^{_OCTET}(?:\.{_OCTET}){{3}}$",
    "card": r"^[3-6]",
    "phone": r"[\x20().-]",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "iban": r"^[A-Z]{2}(?!00)[0-9]{2}",
    "secret": r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_./+-]{12,}$",
    "name": rf"^(?:{TITLES})\b|\x20[A-Z][a-z]{{2,}}$",
}
GAZETTEERS = {
    "email": rf"(?i)(?:\.|dot\W?\s?)(?:{DOMAINS})\s*$",
    "ip": r"^(?!0|127\.|255\.)",
    "card": r"^(?:4|5[1-5]|3[47]|6011|65)",
    "phone": r"^(?:\+[1-9]|\(?[2-9])",
    "ssn": r"^[0-8]",
    "iban": r"^(?:DE|FR|ES|GB|IT|NL|BE|CH|AT|PT|PL|SE|DK|NO|FI|IE)",
    "secret": rf"^(?:{ISSUED})|^(?i:{ASSIGNED})",
    "name": rf"\b(?:{GIVEN_NAMES})\b",
}
ALL_KINDS = [*KINDS, *(k for k in WIDER if k not in KINDS)]
#: Buckets of the classifier's features, rounds of expectation-maximisation, and the probability that adds a span.
BUCKETS, ROUNDS, ACCEPT = 4096, 30, 0.9
#: Ridge and steps of the regression; slots that its buckets are hashed into.
RIDGE, STEPS, SLOTS = 1e-4, 40, 1 << 16
#: Parts of a text that are numbered together (even, as matches are every other one).
PARTS = 128
LABELERS = 4
#: ``before``: up to CONTEXT characters before the span; ``after``: the character that follows.
_SPANS = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
CONTEXT = 30


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _found(text: Column, pattern: str, guard: str) -> Column:
    """Leftmost non-overlapping matches with their code-point positions.

    Every other part of the marked text is a match. Parts are numbered in stretches of PARTS, so that arrays which grow by
    one element at a time stay short however many matches there are.
    """

    last = lambda c: F.substring(c, -CONTEXT, CONTEXT)
    joined = lambda s: F.array_join(F.transform(s, lambda x: x["part"]), "")

    def step(acc: Column, x: Column) -> Column:
        to = acc["at"] + F.length(x["part"])
        span = F.struct(acc["at"].alias("start"), to.alias("end"), x["part"].alias("value"), acc["tail"].alias("before"), x["after"].alias("after"))
        out = F.when(acc["inside"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(to.alias("at"), last(F.concat(acc["tail"], x["part"])).alias("tail"), (~acc["inside"]).alias("inside"), out.alias("out"))

    def begins(stretches: Column) -> Column:
        """(place, what stands before) of each stretch."""
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast("array<struct<at:int,tail:string>>").alias("out"))

        def on(acc: Column, text_: Column) -> Column:
            here = F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"))
            return F.struct((acc["at"] + F.length(text_)).alias("at"), last(F.concat(acc["tail"], text_)).alias("tail"), F.concat(acc["out"], F.array(here)).alias("out"))

        return F.aggregate(F.transform(stretches, joined), start, on, lambda acc: acc["out"])

    def spans(stretches: Column) -> Column:
        empty = F.array().cast(_SPANS)

        def one(both: Column) -> Column:
            start = F.struct(both["from"]["at"].alias("at"), both["from"]["tail"].alias("tail"), F.lit(False).alias("inside"), empty.alias("out"))
            return F.aggregate(both["parts"], start, step, lambda acc: acc["out"])

        return F.flatten(F.transform(F.arrays_zip(stretches.alias("parts"), begins(stretches).alias("from")), one))

    def stretched(parts: Column) -> Column:
        at = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
        # Between two matches side by side stands an empty part.
        known = F.transform(parts, lambda part, i: F.struct(part.alias("part"), F.substring(F.concat(F.substring(at(i + 1), 1, 1), F.substring(at(i + 2), 1, 1)), 1, 1).alias("after")))
        return _let(known, lambda every: F.transform(F.sequence(F.lit(1), F.size(every), F.lit(PARTS)), lambda i: F.slice(every, i, PARTS)))

    marked = F.split(F.regexp_replace(text, pattern, f"{_SIGN}$0{_SIGN}"), _SIGN)
    return F.when(text.rlike(guard), _let(_let(marked, stretched), spans)).otherwise(F.array().cast(_SPANS))


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = digits.substr(F.length(digits) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(FORMATS["ip"])
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    return F.length(digits).between(9, 15)


def _check(kind: str) -> Callable[[Column], Column]:
    return lambda s: _holds(kind, s["value"])


def _of_kind(kind: str, spans: Column) -> Column:
    number = F.lit(ALL_KINDS.index(kind))
    return F.transform(spans, lambda s: F.struct(number.alias("kind"), *[s[f].alias(f) for f in ("start", "end", "value", "before", "after")]))


def base_spans(text: Column) -> Column:
    """The four kinds' spans in order: array of (kind, start, end, value, before, after); kind is a place in ALL_KINDS."""
    return F.concat(*[_of_kind(kind, F.filter(_found(text, BASE[kind], GUARDS[kind]), _check(kind))) for kind in KINDS])


def wider_spans(text: Column) -> Column:
    return F.concat(*[_of_kind(kind, _found(text, WIDER[kind], WIDER_GUARDS[kind])) for kind in WIDER])


def _by_kind(kind: Column, values: dict[str, Column]) -> Column:
    out = None
    for name, value in values.items():
        here = kind == ALL_KINDS.index(name)
        out = F.when(here, value) if out is None else out.when(here, value)
    return out


def labelled(spans: Column, base: bool) -> Column:
    """Spans with their votes (1, 0, -1 by labeler) and the classifier's feature buckets."""

    def look(s: Column) -> Column:
        before, after = s["before"], s["after"]
        yes_no = lambda c: F.when(c, 1).otherwise(-1)
        votes = F.array(
            yes_no(_by_kind(s["kind"], {k: s["value"].rlike(p) for k, p in FORMATS.items()})),
            F.when(_by_kind(s["kind"], {k: s["value"].rlike(p) for k, p in GAZETTEERS.items()}), 1).otherwise(0),
            F.when(before.rlike(ABOUT), 1).when(before.rlike(AGAINST), -1).otherwise(0),
            yes_no(~before.rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]")),
        )
        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(s["value"], "[A-Z]+", "A"), "[a-z]+", "a"), "[0-9]+", "0")
        word = F.lower(F.regexp_extract(before, r"(\p{L}+)\P{L}*$", 1))
        told = [
            ("kind", F.lit("")),
            ("shape", shape),
            ("word", word),
            ("next", F.regexp_replace(after, r"\p{L}", "a")),
            ("near", F.regexp_replace(F.regexp_replace(F.regexp_extract(before, "(.{0,2})$", 1), r"\p{L}", "a"), "[0-9]", "0")),
            ("size", F.length(s["value"]).cast("string")),
            ("first", F.substring(s["value"], 1, 2)),
        ]
        buckets = F.array(*[F.pmod(F.xxhash64(F.lit(name), s["kind"], value), F.lit(BUCKETS)).cast("int") for name, value in told])
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), votes.alias("votes"), buckets.alias("features"))

    return F.transform(spans, look)


def estimate(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[int, tuple[int, ...]], float]:
    """Expectation-maximisation over (kind, votes, count): the probability of personal data by kind and votes.

    Labelers are taken as independent given the truth; each has its own table of what it votes in either case, shared by
    the kinds. The first probabilities come from the majority, which also settles which class is which.
    """
    belief = {(k, v): 1 / (1 + math.exp(-1.5 * sum(v))) for k, v, _ in counts}
    for _ in range(rounds):
        prior: dict[int, list[float]] = {}
        says = [[{-1: 1.0, 0: 1.0, 1: 1.0} for _ in range(2)] for _ in range(LABELERS)]
        for j in range(LABELERS):
            says[j][1][1] += 2.0
            says[j][0][-1] += 2.0
        for k, v, n in counts:
            p = belief[k, v]
            seen = prior.setdefault(k, [1.0, 1.0])
            seen[0] += n * (1 - p)
            seen[1] += n * p
            for j, vote in enumerate(v):
                says[j][1][vote] += n * p
                says[j][0][vote] += n * (1 - p)
        rates = [[{v: c / sum(t.values()) for v, c in t.items()} for t in tables] for tables in says]
        for k, v, _ in counts:
            odds = math.log(prior[k][1] / prior[k][0]) + sum(math.log(rates[j][1][vote] / rates[j][0][vote]) for j, vote in enumerate(v))
            belief[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return belief


def classifier(each: DataFrame, p: Column, staged: Staged) -> tuple[float, list[float]]:
    """(intercept, weight of each bucket) of a logistic regression of the soft labels ``p`` on the features of (features) rows.

    Rows of equal features are one, with the sums of p and 1 - p as the weights of its two labels. The driver sees SLOTS
    coefficients. Without rows everything is zero.
    """
    sums = staged.put(each.groupBy("features").agg(F.sum(p).alias("yes"), F.sum(1 - p).alias("no")), "patterns")
    both = F.inline(F.array(F.struct(F.lit(1.0).alias("label"), F.col("yes").alias("weight")), F.struct(F.lit(0.0).alias("label"), F.col("no").alias("weight"))))
    rows = sums.select("features", both).where("weight > 0")
    if sums.isEmpty():
        return 0.0, [0.0] * BUCKETS
    hashing = HashingTF(numFeatures=SLOTS, binary=True, inputCol="features", outputCol="vector")
    model = LogisticRegression(featuresCol="vector", weightCol="weight", regParam=RIDGE, maxIter=STEPS, standardization=False).fit(hashing.transform(rows))
    coefficients = model.coefficients.toArray()
    slots = hashing.transform(each.sparkSession.range(BUCKETS).select("id", F.array(F.col("id").cast("int")).alias("features"))).collect()
    weights = [0.0] * BUCKETS
    for r in slots:
        weights[r["id"]] = float(coefficients[r["vector"].indices[0]])
    return float(model.intercept), weights


def _is(kind: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans (base and added).

    The counts and base_sha256 are of the base spans (``kind:start:end``, in code points, comma-joined by kind, then
    start); ``spans`` lists the base spans and those that the classifier adds, kinds with base rules first.

    Null and empty texts have no spans. A text of any length is searched whole by one task, in time that grows with it and its
    spans; a row holds all of a text's spans. Repeated rows and null ids give a result each; extra columns are ignored; an empty
    table gives an empty result. The driver sees one count for each vote pattern and kind and one weight for each feature
    bucket, both bounded by parameters.
    """
    spark = docs.sparkSession
    staged = Staged(spark)
    plain = F.translate(F.coalesce(F.col(text_col), F.lit("")), _SIGN, _OTHER)
    read = docs.select(F.col(id_col).cast("long").alias("id"), plain.alias("text")).select("id", "text", base_spans(F.col("text")).alias("base"), wider_spans(F.col("text")).alias("wider"))
    apart = F.filter("wider", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    held = staged.put(
        read.withColumn("apart", apart).select(
            "id",
            F.transform("base", lambda s: s.dropFields("value", "before", "after")).alias("base"),
            F.concat(labelled(F.col("base"), True), labelled(F.col("apart"), False)).alias("candidates"),
        ),
        "spans",
    )
    each = held.select(F.inline("candidates"))
    votes = each.groupBy("kind", "votes").count().collect()  # at most kinds x 3**labelers rows
    belief = estimate([(r["kind"], tuple(r["votes"]), r["count"]) for r in votes])
    told = json.dumps({f"{k}:{','.join(map(str, v))}": p for (k, v), p in belief.items()} or {"": 0.5})
    p = F.coalesce(F.from_json(F.lit(told), "map<string,double>")[F.concat_ws(":", F.col("kind").cast("string"), F.array_join(F.col("votes").cast("array<string>"), ","))], F.lit(0.5))
    prior, weights = classifier(each, p, staged)
    weight = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    decided = lambda c: F.aggregate(c["features"], F.lit(prior), lambda acc, f: acc + F.get(weight, f)) > math.log(ACCEPT / (1 - ACCEPT))
    added = F.filter("candidates", lambda c: ~c["base"] & decided(c))
    names = F.array(*map(F.lit, ALL_KINDS))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    every = F.array_sort(F.concat("base", F.transform("added", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))))
    return held.withColumn("added", added).select(
        F.col("id").alias(id_col),
        *[F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(every).alias("spans"),
        F.size("added").alias("n_added"),
        (F.size("base") + F.size("added")).alias("n_spans"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
