"""Personal data by weak supervision.

Patterns find candidate spans. Labelers - the pattern's own check, gazetteers of words before the span, the characters
around it, the variety of characters in it - vote for, against, or abstain. Expectation-maximisation over the counts of
vote patterns estimates each labeler's reliability and each pattern's posterior; a logistic span classifier is
trained on these soft labels and decides on every candidate that isn't base. Base spans always stay.

The counts have one row per kind, votes and length class, so their number is fixed by the method, not by the data.
Native: DataFrame functions only; spans are located by the lengths of what lies between matches.

Defined results: a null text has no spans; repeated rows are scanned each; a null doc_id is kept; an empty table gives
no rows and a classifier that accepts nothing; other columns are ignored. Patterns are possessive or anchored at the
start of a run, so very long runs of digits or letters take linear time."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, text_of, written

# The base patterns, in the order in which kinds are listed.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates, which the classifier must accept.
MORE = {
    "contact": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]++)++",
    "local_phone": r"(?<![0-9+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "number": r"(?<![0-9A-Za-z])[0-9]{9,}+(?![A-Za-z])",
    "secret": r"(?<![0-9A-Za-z_+/-])(?=[A-Za-z_+/-]*+[0-9])[0-9A-Za-z_+/-]{20,}+",
}
#: What a text must contain before a pattern is tried.
NEEDS = {"email": "@", "contact": "(at)"}
KINDS = [*BASE, *MORE]
#: Gazetteers of words shortly before a span.
CUES = "account address api auth bearer call card contact email fax host iban ip key mail mobile passwd password phone private pwd secret server ssn tel token user visa".split()
HARMLESS = "article build chapter commit doi figure isbn issn issue license licensed order page release section serial version volume year".split()
BEFORE = 32
LABELERS = ("check", "gazetteer", "context", "variety")

FOUND = "array<struct<kind:string,start:int,end:int,text:string,before:string,after:string,check:int>>"


def _located(text: Column, kind: str, pieces: Column, matches: Column) -> Column:
    """Array of the matches of a kind with their places; pieces: the text between them."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        item = F.struct(start.alias("start"), x["hit"].alias("text"), F.right(F.concat(acc["prev"], x["gap"]), F.lit(BEFORE)).alias("before"), x["next"].alias("after"))
        return F.struct((start + F.length(x["hit"])).alias("pos"), x["hit"].alias("prev"), F.concat(acc["out"], F.array(item)).alias("out"))

    n = F.size(matches)
    rows = F.transform(matches, lambda m, i: F.struct(F.get(pieces, i).alias("gap"), m.alias("hit"), F.substring(F.get(pieces, i + 1), 1, 2).alias("next")))
    empty = F.lit(None).cast("array<struct<start:int,text:string,before:string,after:string>>")
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("prev"), F.coalesce(empty, F.expr("cast(array() as array<struct<start:int,text:string,before:string,after:string>>)")).alias("out"))
    return F.when(n > 0, F.aggregate(rows, start, step)["out"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        x = F.substring(d, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0


def _passes(kind: str, s: Column) -> Column:
    """The check of a base kind."""
    d = _digits(s)
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(s, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(d).between(9, 15)
    return F.lit(True)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds base and more: arrays of spans (kind, start, end, text, before, after, check); more: those that touch no base span."""
    keep = [F.col(f"`{c}`") for c in docs.columns]
    df = docs.withColumn("_t", text_of(text)).withColumn("_digit", F.col("_t").rlike("[0-9]"))
    for kind, pattern in (BASE | MORE).items():
        gate = F.contains(F.col("_t"), F.lit(NEEDS[kind])) if kind in NEEDS else F.col("_digit")
        if kind == "phone":
            gate = gate & F.contains(F.col("_t"), F.lit("+"))
        if kind == "contact":
            gate = F.col("_t").rlike(r"[\[(](?:at|AT)[\])]")
        df = df.withColumn(f"_m_{kind}", F.when(gate, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))))
    for kind, pattern in (BASE | MORE).items():
        hit = F.col(f"_m_{kind}")
        df = df.withColumn(f"_p_{kind}", F.when(F.size(hit) > 0, F.split("_t", pattern, -1)))
    for kind in KINDS:
        df = df.withColumn(f"_l_{kind}", _located(F.col("_t"), kind, F.col(f"_p_{kind}"), F.col(f"_m_{kind}"))).drop(f"_p_{kind}", f"_m_{kind}")
    none = F.expr(f"cast(array() as {FOUND})")

    def spans(kind: str) -> Column:
        good = lambda x: _passes(kind, x["text"]) if kind in BASE else F.lit(None).cast("boolean")
        check = lambda x: F.when(good(x), 1).when(~good(x), -1).otherwise(0).cast("int")
        if kind == "secret":
            check = lambda x: F.when(x["text"].rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"), 1).when(~x["text"].rlike("[A-Za-z]"), -1).otherwise(0).cast("int")
        make = lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["text"])).alias("end"), x["text"].alias("text"), x["before"].alias("before"), x["after"].alias("after"), check(x).alias("check"))
        return F.coalesce(F.transform(f"_l_{kind}", make), none)

    df = df.withColumn("_base", F.concat(*[spans(k) for k in BASE])).withColumn("_more", F.concat(*[spans(k) for k in MORE]))
    df = df.withColumn("base", F.filter("_base", lambda x: x["check"] == 1))
    failed = F.filter("_base", lambda x: (x["check"] != 1) & (F.length(_digits(x["text"])) >= 9))
    df = df.withColumn("_rest", F.concat("_more", failed))
    apart = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return df.select(*keep, "base", F.when(F.size("_rest") > 0, F.filter("_rest", apart)).otherwise(F.col("_rest")).alias("more"))


def votes(x: Column) -> Column:
    """Struct of a span's votes (-1, 0, 1) and length class."""
    word = lambda names: F.lower(x["before"]).rlike("(?<![a-z])(?:" + "|".join(names) + ")(?![a-z])")
    gaz = F.when(word(CUES), 1).when(word(HARMLESS), -1).otherwise(0)
    quoted = x["before"].rlike("[=:\"'] ?$")
    touching = x["before"].rlike("[0-9A-Za-z.,/_-]$") | x["after"].rlike("^(?:[0-9A-Za-z/_-]|[.,][0-9])")
    context = F.when(quoted, 1).when(touching, -1).otherwise(0)
    kinds = F.size(F.array_distinct(F.split(x["text"], "")))
    variety = F.when(kinds >= 6, 1).when(kinds <= 3, -1).otherwise(0)
    n = F.length(x["text"])
    return F.struct(x["kind"].alias("kind"), x["check"].alias("check"), gaz.alias("gazetteer"), context.alias("context"), variety.alias("variety"), F.when(n < 14, 0).when(n < 30, 1).otherwise(2).alias("length"))


def reliabilities(patterns: dict[tuple, int], rounds: int = 60) -> tuple[dict, dict]:
    """EM over counts of (kind, votes..., length): P(vote | label) of each labeler, and the posterior of each pattern.

    Labels are independent votes given the truth; counts are smoothed by one; it starts from the majority of votes."""
    post = {p: 1 / (1 + math.exp(-1.5 * sum(p[1:5]))) for p in patterns}
    rel: dict = {}
    for _ in range(rounds):
        prior = defaultdict(lambda: [1.0, 1.0])
        rel = {lab: {(v, y): 1.0 for v in (-1, 0, 1) for y in (0, 1)} for lab in LABELERS}
        for p, n in patterns.items():
            for y, q in ((0, 1 - post[p]), (1, post[p])):
                prior[p[0]][y] += n * q
                for lab, v in zip(LABELERS, p[1:5], strict=True):
                    rel[lab][v, y] += n * q
        for table_ in rel.values():
            for y in (0, 1):
                total = sum(table_[v, y] for v in (-1, 0, 1))
                for v in (-1, 0, 1):
                    table_[v, y] /= total
        for p in patterns:
            odds = math.log(prior[p[0]][1] / prior[p[0]][0]) + sum(math.log(rel[lab][v, 1] / rel[lab][v, 0]) for lab, v in zip(LABELERS, p[1:5], strict=True))
            post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return rel, post


def _features(p: tuple) -> list[tuple]:
    return [("kind", p[0]), *((lab, v) for lab, v in zip(LABELERS, p[1:5], strict=True) if v), ("length", p[5])]


def span_classifier(patterns: dict[tuple, int], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict[tuple, float]:
    """Weights of a logistic classifier, fitted to the posteriors by gradient steps over pattern counts (log counts weigh)."""
    _, post = reliabilities(patterns)
    w: dict[tuple, float] = defaultdict(float)
    weight = {p: math.log1p(n) for p, n in patterns.items()}
    total = sum(weight.values()) or 1.0
    for _ in range(rounds):
        grad: dict[tuple, float] = defaultdict(float)
        for p in patterns:
            z = sum(w[f] for f in _features(p))
            g = weight[p] / total * (post[p] - 1 / (1 + math.exp(-z)))
            for f in _features(p):
                grad[f] += g
        for f, g in grad.items():
            w[f] += rate * 10 * (g - decay * w[f] / 10)
    return dict(w)


def score(v: Column, weights: dict[tuple, float]) -> Column:
    z = F.lit(0.0)
    for (name, value), w in sorted(weights.items(), key=str):
        z = z + F.when(v[name] == value, float(w)).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def trained(found: DataFrame) -> dict[tuple, float]:
    """From rows with base and more: the classifier. Counts come from all rows; at most 8 kinds x 81 votes x 3 lengths."""
    v = F.explode(F.transform(F.concat("base", "more"), votes)).alias("v")
    rows = found.select(v).groupBy("v").count().collect()
    return span_classifier({tuple(r["v"][k] for k in ("kind", *LABELERS, "length")): r["count"] for r in rows}) if rows else {}


def accepted(more: Column, weights: dict[tuple, float], least: float = 0.5) -> Column:
    if not weights:
        return F.filter(more, lambda x: F.lit(False))
    pairs = F.transform(more, lambda x: F.struct(x.alias("x"), votes(x).alias("v")))
    return F.transform(F.filter(pairs, lambda p: score(p["v"], weights) >= least), lambda p: p["x"])


def in_order(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(F.element_at(rank, x["kind"]).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["pos"]
        add = F.concat(F.substring(text, acc["pos"] + 1, x["start"] - acc["pos"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), F.when(fresh, F.concat(acc["out"], add)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    done = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(candidates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "pii-candidates")
    weights = trained(found)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    spans = F.concat("base", accepted(F.col("more"), weights))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(in_order(F.col("base")).cast("binary"), 256).alias("base_sha256"), in_order(spans).alias("spans"))
