"""Personal data by weak supervision, in DataFrame functions only.

Base kinds (email, ip, card, phone) are patterns with checks. Beside them every word that holds a digit or an @, and
every value assigned to a secret cue (``password=x``, ``token = x``), is a candidate on which regex, gazetteer and context labelers vote (1 personal, -1 not, 0 abstains). Expectation maximisation
over the counted vote patterns estimates how reliable each labeler is; its posteriors train a logistic span classifier on
the candidate's shape and context, which decides on the candidates that no base span touches (kind ``secret``).

Positions are code points: a text is split at the matches, and lengths are added up.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drayline.session import workspace

KINDS = ("email", "ip", "card", "phone")
ADDED = "secret"
SPAN = "struct<start:int,end:int,hit:string,before:string>"

#: Each gives the same matches as the plain pattern, but in time linear in the text: it starts only where a run starts (or
#: where the last match ended), never gives characters back, and no repeated group makes the matcher recurse.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.?(?:[^A-Za-z0-9.-]|\z)|\.\.)",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=(?:[ -]?[0-9]){12})[0-9 -]*?(?=[ -]?(?:[^0-9 -]|\z)|[ -][ -])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
CUE = r"(?i:password|passwd|pwd|secret|token|api_?key)"
CANDIDATE = (
    r"(?:\A|(?<=[ \t-\r]))(?:[^ \t-\r0-9@]*+[0-9@][^ \t-\r]*+"  # a word with a digit or an @
    rf"|[^ \t-\rA-Za-z0-9]*+{CUE}[^ \t-\rA-Za-z0-9=:]*+[=:][^ \t-\r]++"  # a cue with its value
    rf"|(?<={CUE}[\"']{{0,1}}[ \t]{{0,2}}[=:][ \t]{{1,2}})[^ \t-\r]++)"  # the value after a cue
)
CONTEXT = 24

Test = Callable[[Column, Column], Column]


def hit(*patterns: str) -> Test:
    return lambda h, before: reduce(or_, (h.rlike(p) for p in patterns))


def after(pattern: str) -> Test:
    return lambda h, before: before.rlike(pattern)


def length(least: int, most: int = 1 << 30) -> Test:
    return lambda h, before: F.length(h).between(least, most)


def both(*tests: Test) -> Test:
    return lambda h, before: reduce(and_, (t(h, before) for t in tests))


def either(*tests: Test) -> Test:
    return lambda h, before: reduce(or_, (t(h, before) for t in tests))


def card_number(h: Column, before: Column) -> Column:
    digits = F.regexp_replace(h, r"\W$", "")
    return F.when(digits.rlike("^[0-9]{13,19}$"), luhn(digits)).otherwise(False)


def unchecked_number(h: Column, before: Column) -> Column:
    """So many digits as a card, but the check digit is wrong."""
    return h.rlike(r"^[0-9]{13,}\W?$") & ~card_number(h, before)


never: Test = lambda h, before: F.lit(False)

LABELERS: dict[str, tuple[Test, Test]] = {  # (votes personal, votes not)
    "regex_secret": (hit(r"(?i)^\W*(password|passwd|pwd|secret|token|api_?key)\W*[=:]", "AKIA[0-9A-Z]{16}"), never),
    "regex_identifier": (either(hit(r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.", r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), card_number), unchecked_number),
    "gazetteer": (hit(r"(?i)(mail|example\.com|akia|password|token|bearer|ssh-)"), after("(?i)(version|licen[sc]e|apache|cc by|gnu|copyright)")),
    "context": (after(r"(?i)(password|passwd|token|secret|key|login|mail|phone|tel|call|card)\W{0,4}$"), after(r"(?i)(version|page|chapter|section|year|no|vol)\W{0,2}$")),
    "shape": (both(length(16), hit("[0-9]"), hit("[A-Za-z]")), hit(r"^[0-9]{1,8}\W?$", r"^[0-9]+\.[0-9]+\W?$")),
    "digits": (both(hit(r"^[+(]?[0-9][0-9().-]{8,}\W?$"), lambda h, before: ~unchecked_number(h, before)), either(length(0, 6), unchecked_number)),
}
FEATURES: dict[str, Test] = {
    "at": hit("@"),
    "long": length(12),
    "mixed": both(hit("[0-9]"), hit("[A-Za-z]")),
    "assigned": either(hit("[=:]"), after(r"[=:]\W*$")),
    "capitals": hit(r"^[A-Z0-9]{12,}\W?$"),
    "hex": hit("[0-9a-f]{16,}"),
    "few_digits": hit(r"^\D*+[0-9]{1,4}\D*+$"),
    "short": length(0, 6),
    "number": hit(r"^[0-9.,]+\W?$"),
    "unchecked": unchecked_number,
    "numbered": LABELERS["context"][1],
    "cue": LABELERS["context"][0],
}


def found(text: Column, pattern: str) -> Column:
    """All matches as (start, end, hit, before); ``before`` is the end of what lies between it and the previous one."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    step = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))

    def put(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(CONTEXT)).alias("before"))
        return F.struct(end.alias("at"), F.array_append(done["spans"], span).alias("spans"))

    empty = F.array().cast(f"array<{SPAN}>")
    return F.aggregate(step, F.struct(F.lit(0).alias("at"), empty.alias("spans")), put, lambda done: done["spans"])


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def more(total: Column, i: Column) -> Column:
        d = F.ascii(digits.substr(i, F.lit(1))) - 48
        return total + F.when((n - i) % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), more) % 10 == 0


def holds(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.length(_digits(hit)).between(13, 19) & luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _checked(kind: str) -> Callable[[Column], Column]:
    return lambda x: holds(kind, x["hit"])


def annotated(docs: DataFrame) -> DataFrame:
    """``docs`` with an array of spans per base kind and one of candidates, in columns named ``pii_*``."""
    none = F.array().cast(f"array<{SPAN}>")
    out = docs.withColumn("pii_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumn("pii_digit", F.col("pii_text").rlike("[0-9]"))
    text = F.col("pii_text")
    for kind in KINDS:
        worth = F.lit(True) if kind == "email" else F.col("pii_digit")
        if NEEDS[kind]:
            worth &= text.contains(NEEDS[kind])
        out = out.withColumn(f"pii_{kind}", F.when(worth, F.filter(found(text, PATTERNS[kind]), _checked(kind))).otherwise(none))
    return out.withColumn("pii_candidate", F.when(F.col("pii_digit") | text.contains("@") | text.rlike(CUE), found(text, CANDIDATE)).otherwise(none)).drop("pii_digit")


def _patterns(candidates: DataFrame) -> list[tuple[tuple[int, ...], tuple[int, ...], int]]:
    """(votes, features, how many) over all candidates; their number is bounded by the labelers and features."""
    rows = candidates.select(F.explode("pii_candidate").alias("c")).select("c.hit", "c.before")
    about = F.col("hit"), F.col("before")
    votes = [F.when(yes(*about), 1).when(no(*about), -1).otherwise(0).alias(f"v_{k}") for k, (yes, no) in LABELERS.items()]
    features = [test(*about).cast("int").alias(f"f_{k}") for k, test in FEATURES.items()]
    names = [f"v_{k}" for k in LABELERS] + [f"f_{k}" for k in FEATURES]
    counted = rows.select(*votes, *features).groupBy(*names).count().collect()
    cut = len(LABELERS)
    return sorted((tuple(r[n] for n in names[:cut]), tuple(r[n] for n in names[cut:]), r["count"]) for r in counted)


def estimate(patterns: list[tuple[tuple[int, ...], tuple[int, ...], int]], rounds: int = 50) -> list[float]:
    """Posterior of being personal for each pattern, by expectation maximisation over the labelers' reliabilities."""
    posterior = [0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.3 for v, _, _ in patterns]
    for _ in range(rounds):
        total = [1.0, 1.0]
        seen = [[{-1: 0.1, 0: 0.1, 1: 0.1} for _ in LABELERS] for _ in range(2)]
        # a prior that no labeler is worse than chance
        for k in range(len(LABELERS)):
            seen[1][k][1] += 1.0
            seen[0][k][-1] += 1.0
        for (votes, _, count), p in zip(patterns, posterior):
            for side, share in ((1, p), (0, 1 - p)):
                total[side] += share * count
                for k, vote in enumerate(votes):
                    seen[side][k][vote] += share * count
        logs = []
        for side in range(2):
            weights = [{vote: math.log(n / sum(by.values())) for vote, n in by.items()} for by in seen[side]]
            logs.append((math.log(total[side] / sum(total)), weights))
        posterior = []
        for votes, _, _ in patterns:
            sides = [base + sum(w[vote] for w, vote in zip(weights, votes)) for base, weights in logs]
            posterior.append(1 / (1 + math.exp(max(-500.0, min(500.0, sides[0] - sides[1])))))
    return posterior


def train(patterns: list[tuple[tuple[int, ...], tuple[int, ...], int]], posterior: list[float], steps: int = 400) -> list[float]:
    """Bias and weights of the span classifier, fit to the posteriors by gradient descent."""
    weights = [0.0] * (1 + len(FEATURES))
    total = sum(n for _, _, n in patterns) or 1
    for _ in range(steps):
        gradient = [1e-3 * w for w in weights]
        for (_, features, n), p in zip(patterns, posterior):
            s = weights[0] + sum(w for w, f in zip(weights[1:], features) if f)
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) - p) * n / total
            for i, f in enumerate((1, *features)):
                gradient[i] += error * f
        weights = [w - 2.0 * g for w, g in zip(weights, gradient)]
    return weights


def fit(candidates: DataFrame) -> list[float]:
    """The classifier for a table with a column ``pii_candidate``."""
    patterns = _patterns(candidates)
    return train(patterns, estimate(patterns)) if patterns else [-1.0] + [0.0] * len(FEATURES)


def _accepted(weights: list[float]) -> Column:
    """Candidates that the classifier takes for personal and that touch no base span."""
    base = F.concat(*(F.col(f"pii_{k}") for k in KINDS))

    def personal(c: Column) -> Column:
        parts = [F.when(test(c["hit"], c["before"]), w).otherwise(0.0) for test, w in zip(FEATURES.values(), weights[1:])]
        clear = ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return clear & (reduce(add, parts, F.lit(weights[0])) > 0)

    return F.filter(F.col("pii_candidate"), personal)


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))


def spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id and arrays of spans per kind (``email ip card phone secret``) of every whole text.

    A NULL or empty text has none. Ids may be NULL or repeat: one result per row. Other columns are not read. Base spans
    of different kinds may overlap; candidates that touch one are left to it. Nothing is learned from an empty table.
    """
    path = workspace(spark, "pii")
    annotated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text", "pii_text").write.parquet(path)
    marked = spark.read.parquet(path)
    weights = fit(marked)
    return marked.select("doc_id", *(F.col(f"pii_{k}").alias(k) for k in KINDS), _accepted(weights).alias(ADDED))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and the list of all spans."""
    base = F.array_join(F.concat(*(_named(k, F.col(k)) for k in KINDS)), ",")
    every = F.array_join(F.concat(*(_named(k, F.col(k)) for k in (*KINDS, ADDED))), ",")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), every.alias("spans"), F.size(ADDED).cast("long").alias("n_secret"))


def _tagged(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"[{kind}]").alias("mark"))


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans by that of the first.

    Columns, rows and their number stay as they are; a NULL text stays NULL.
    """
    path = workspace(spark, "pii")
    annotated(docs.select("text")).select("pii_candidate").where(F.size("pii_candidate") > 0).write.parquet(path)
    # The rows travel as one column, so that no column of theirs can have the name of a working column.
    rows = docs.select(F.struct(*docs.columns).alias("pii_row"), "text")
    marked = annotated(rows).withColumn("pii_secret", _accepted(fit(spark.read.parquet(path))))
    tagged = [F.transform(F.col(f"pii_{k}"), _tagged(k)) for k in (*KINDS, ADDED)]
    marked = marked.withColumn("pii_all", F.array_sort(F.concat(*tagged)))
    text = F.col("pii_text")

    def put(done: Column, x: Column) -> Column:
        fresh = x["start"] >= done["at"]
        between = text.substr(done["at"] + 1, x["start"] - done["at"])
        return F.struct(F.greatest(done["at"], x["end"]).alias("at"), F.when(fresh, F.concat(done["out"], between, x["mark"])).otherwise(done["out"]).alias("out"))

    cut = F.aggregate("pii_all", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put, lambda done: F.concat(done["out"], text.substr(done["at"] + 1, F.length(text))))
    redacted = F.when(F.size("pii_all") > 0, cut).otherwise(F.col("text"))
    return marked.select(*(redacted.alias(c) if c == "text" else F.col("pii_row")[c].alias(c) for c in docs.columns))
