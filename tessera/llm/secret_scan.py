"""Secrets by grammar inference.

Patterns find the base spans, which always stay. Their values are the labelled credentials. A credential becomes a string of
symbols: a mark for the set of characters it uses, its first characters as they are where most credentials of the same set and
source share them ("AKIA"), every other letter or digit as one symbol, punctuation as it is. Of a value of over ``LONG`` characters the first ``SHOWN`` are
written so, and one symbol stands for all others: which punctuation they hold, and their number to a power of two. From the counts of these strings a
prefix tree is built, and states whose futures are statistically compatible (Hoeffding's bound on their frequencies) are merged,
red and blue (ALERGIA: Carrasco and Oncina, 1994), into a probabilistic automaton for each kind. Every other token of the texts
is a candidate; its score is the likelihood of its format by the best automaton, and it is a span if the score reaches the one that all but
``MISSED`` of the labelled credentials reach.

Styles: texts are searched by Python on Arrow batches, each on its own; counts are DataFrame aggregates over all documents; the
merging is plain Python on the driver, on at most ``FORMATS`` symbol strings a kind (formats, not credentials: there are few, as the values of a format make one
string; beyond the bound a hash chooses).

Defined results: a null text is empty and has no spans; repeated rows are scanned each; a null doc_id is kept; an empty table gives no rows; without
credentials nothing is added; other columns are ignored. Very long texts and runs take linear time; credentials and candidates may have any length. Spans of equal start are in the order of their kinds."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import table, written

# The base patterns, in the order in which kinds are listed, and the least number of characters.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: A whole run either way, so runs that are too short needn't be looked at.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

KINDS = [*LEAST, "format"]
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Longer values have a coarse format, their first characters and a symbol for the others; the punctuation that values may hold, sorted.
LONG, SHOWN, MARKS = 512, 16, "+-./=_"
#: First characters that may be kept, and the share of credentials that must have them.
PREFIX, COMMON = 8, 0.5
#: Bound on the symbol strings of a kind that a fit sees, significance of a difference, share of credentials that the threshold may miss.
FORMATS, ALPHA, MISSED = 5000, 0.05, 0.01
#: A kind with fewer credentials has no automaton.
FEWEST = 5
END = ""


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """start, place of the kind, end, value of each base span, in order."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """start, end, value of the tokens with a digit and a letter that touch no base span."""
    out, k = [], 0
    for m in TOKEN.finditer(text):
        if m[0].isalpha() or not charset(m[0]):
            continue
        while k < len(base) and base[k][2] <= m.start():
            k += 1
        if k == len(base) or base[k][0] >= m.end():  # later ones start later
            out.append((m.start(), m.end(), m[0]))
    return out


_SETS = [("hex", re.compile(r"[0-9a-f]+")), ("HEX", re.compile(r"[0-9A-F]+")), ("lower", re.compile(r"[0-9a-z]+")), ("upper", re.compile(r"[0-9A-Z]+"))]
_ALNUM = re.compile(r"[^0-9A-Za-z]+")


def charset(value: str) -> str:
    """The narrowest set of characters that holds the letters and digits; empty if they aren't both there (numbers and words are no credentials)."""
    plain = _ALNUM.sub("", value)
    if plain.isalpha() or plain.isdigit() or not plain:
        return ""
    return next((name for name, pattern in _SETS if pattern.fullmatch(plain)), "mixed")


def parts(value: str) -> dict[str, str | None]:
    """What a format needs: the set of characters, the value (of a long one its first characters) and the symbol for what a long one has after them."""
    if len(value) <= LONG:
        return {"set": charset(value), "value": value, "other": None}
    rest = value[SHOWN:]
    return {"set": charset(value), "value": value[:SHOWN], "other": "".join(c for c in MARKS if c in rest) + f">{len(rest).bit_length()}"}


def symbols(of: dict[str, str | None], prefix: dict[str, str]) -> tuple[str, ...]:
    """The parts of a value as symbols; prefix: the common first characters by set."""
    head = prefix.get(of["set"], "")
    if not of["value"].startswith(head):
        head = ""
    return (of["set"], *head, *[c if not c.isalnum() else "*" for c in of["value"][len(head) :]], *([of["other"]] if of["other"] else []))


class Automaton:
    """A prefix tree of counted strings whose compatible states are merged."""

    def __init__(self, counted: dict[tuple[str, ...], int], alpha: float = ALPHA) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [defaultdict(int)]
        for string, n in sorted(counted.items()):
            at = 0
            for s in string:
                self.seen[at][s] += n
                if s not in self.next[at]:
                    self.next[at][s] = len(self.next)
                    self.next.append({})
                    self.seen.append(defaultdict(int))
                at = self.next[at][s]
            self.seen[at][END] += n
        self.total = [sum(x.values()) for x in self.seen]
        self.width = math.sqrt(0.5 * math.log(2 / alpha))
        self.red = self._merged()

    def compatible(self, a: int, b: int) -> bool:
        """Whether the frequencies of all continuations of both states differ by no more than chance allows."""
        stack = [(a, b)]
        while stack:
            p, q = stack.pop()
            n, m = self.total[p], self.total[q]
            if not n or not m:
                continue
            bound = self.width * (n**-0.5 + m**-0.5)
            if any(abs(self.seen[p].get(s, 0) / n - self.seen[q].get(s, 0) / m) > bound for s in self.seen[p].keys() | self.seen[q].keys()):
                return False
            stack += [(t, self.next[q][s]) for s, t in self.next[p].items() if s in self.next[q]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree under b to the automaton at a. A blue state's subtree is still a tree, so this ends."""
        stack = [(a, b)]
        while stack:
            p, q = stack.pop()
            for s, n in self.seen[q].items():
                self.seen[p][s] += n
            self.total[p] += self.total[q]
            for s, t in self.next[q].items():
                if s in self.next[p]:
                    stack.append((self.next[p][s], t))
                else:
                    self.next[p][s] = t

    def _merged(self) -> list[int]:
        red, known = [0], {0}
        while True:
            blue = next(((r, s, t) for r in red for s, t in sorted(self.next[r].items()) if t not in known), None)
            if blue is None:
                return red
            r, s, t = blue
            to = next((x for x in red if self.compatible(x, t)), None)
            if to is None:
                red.append(t)
                known.add(t)
            else:
                self.next[r][s] = to
                self._fold(to, t)

    def score(self, string: tuple[str, ...]) -> float:
        """Log likelihood of the string, by symbol; -inf where the automaton has no way."""
        at, out = 0, 0.0
        for s in (*string, END):
            n = self.seen[at].get(s, 0)
            if not n:
                return -math.inf
            out += math.log(n / self.total[at])
            at = self.next[at].get(s, at)
        return out / (len(string) + 1)


class Formats:
    """An automaton, the common beginnings and a threshold for each kind."""

    def __init__(self, prefix: dict[str, dict[str, str]], formats: list[tuple[str, tuple[str, ...], int]]) -> None:
        """prefix: common beginnings by kind and set. formats: kind, symbols, count of the credentials."""
        self.prefix = prefix
        self.kinds: dict[str, tuple[Automaton, float]] = {}
        by: dict[str, dict[tuple[str, ...], int]] = defaultdict(lambda: defaultdict(int))
        for kind, string, n in formats:
            by[kind][string] += n
        for kind, counted in sorted(by.items()):
            total = sum(counted.values())
            if total < FEWEST:
                continue
            model = Automaton(dict(counted))
            missed, least = 0, -math.inf
            for score, n in sorted((model.score(s), n) for s, n in counted.items()):
                least = score
                missed += n
                if missed > MISSED * total:
                    break
            self.kinds[kind] = (model, least)
        self.accepts = lru_cache(100_000)(self._accepts)

    def _accepts(self, kind: str, string: tuple[str, ...]) -> bool:
        model, least = self.kinds[kind]
        return model.score(string) >= least - 1e-9

    def accept(self, of: dict[str, str | None]) -> bool:
        """of: the parts of a value."""
        return any(self.accepts(kind, symbols(of, self.prefix.get(kind, {}))) for kind in self.kinds)

    def __reduce__(self) -> tuple:
        return _formats, (self.prefix, self.kinds)


def _formats(prefix: dict, kinds: dict) -> Formats:
    out = Formats(prefix, [])
    out.kinds = kinds
    return out


#: Spans hold the parts of their values, so that long ones aren't stored beside their texts.
SPAN = "start:int,end:int,set:string,value:string,other:string"
FOUND = f"doc_id long, base array<struct<kind:string,{SPAN}>>, more array<struct<{SPAN}>>"


def found(docs: DataFrame) -> DataFrame:
    """From doc_id, text: doc_id, base, more (the candidates)."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            base = [base_spans(t or "") for t in pdf["text"]]
            more = [[{"start": s, "end": e, **parts(v)} for s, e, v in candidates(t or "", b)] for t, b in zip(pdf["text"], base, strict=True)]
            shown = [[{"kind": KINDS[k], "start": s, "end": e, **parts(v)} for s, k, e, v in b] for b in base]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "base": shown, "more": more})

    return docs.select("doc_id", "text").mapInPandas(search, FOUND)


def fit(rows: DataFrame, most: int = FORMATS) -> Formats:
    """From the base spans of rows (doc_id, base, more). Counts are over all documents; of the formats at most ``most`` a kind reach the driver."""
    labelled = rows.select(F.explode("base").alias("b")).select("b.kind", "b.set", "b.value", "b.other").where("set <> ''")
    # Spark counts equal formats together: the set, the first characters, the value with all other letters and digits alike, and the symbol for the rest of a long one
    # beginnings of every length, of which only those that few others can share with are kept
    starts = labelled.select("kind", "set", F.explode(F.transform(F.sequence(F.lit(2), F.lit(PREFIX)), lambda k: F.substring("value", F.lit(1), k))).alias("head"))
    totals = labelled.groupBy("kind", "set").agg(F.count(F.lit(1)).alias("total"))
    shared = starts.groupBy("kind", "set", "head").agg(F.count(F.lit(1)).alias("n")).join(totals, ["kind", "set"]).where((F.col("n") >= F.col("total") * COMMON) & (F.col("n") >= FEWEST))
    heads = {(r["kind"], r["set"]): r["head"] for r in shared.groupBy("kind", "set").agg(F.max_by("head", F.struct(F.length("head"), "head")).alias("head")).collect()}  # one row for each kind and set at most
    known = F.lit(None).cast("string")
    for (kind, of), head in sorted(heads.items()):
        known = F.when((F.col("kind") == kind) & (F.col("set") == of) & F.startswith("value", F.lit(head)), F.lit(head)).otherwise(known)
    tail = F.regexp_replace(F.substring("value", F.length(F.coalesce("head", F.lit(""))) + 1, F.length("value")), "[0-9A-Za-z]", "*")
    counted = labelled.withColumn("head", known).groupBy("kind", "set", "head", tail.alias("tail"), "other").agg(F.count(F.lit(1)).alias("n"))
    # no kind has more than the bound; the hash decides, not the order of rows
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.xxhash64("set", "head", "tail", "other"), "tail"))
    chosen = counted.withColumn("place", place).where(F.col("place") <= most).collect()
    formats = [(r["kind"], (r["set"], *(r["head"] or ""), *r["tail"], *([r["other"]] if r["other"] else [])), r["n"]) for r in chosen]
    prefix: dict[str, dict[str, str]] = defaultdict(dict)
    for (kind, of), head in heads.items():
        prefix[kind][of] = head
    return Formats(dict(prefix), formats)


def scored(rows: DataFrame, model: Formats) -> DataFrame:
    """doc_id, base, and format: the candidates whose format is likely enough; value: of a long one its first characters."""

    def accept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = [[{"kind": "format", "start": x["start"], "end": x["end"], "value": x["value"]} for x in more if model.accept(x)] for more in pdf["more"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "base": pdf["base"], "format": kept})

    out = f"doc_id long, base array<struct<kind:string,{SPAN}>>, format array<struct<kind:string,start:int,end:int,value:string>>"
    return rows.select("doc_id", "base", "more").mapInPandas(accept, out)


def listed(spans: list) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rows = sorted((x["start"], KINDS.index(x["kind"]), x["end"]) for x in spans)
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in rows)


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(found(table(spark, sf_dir, "documents")), "secret-candidates")
    spans = scored(rows, fit(rows))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["doc_id"]].astype("Int64")
            for kind in LEAST:
                out[f"n_{kind}"] = [sum(x["kind"] == kind for x in b) for b in pdf["base"]]
            out["base_sha256"] = [hashlib.sha256(listed(b).encode()).hexdigest() for b in pdf["base"]]
            out["spans"] = [listed([*b, *f]) for b, f in zip(pdf["base"], pdf["format"], strict=True)]
            yield out

    return spans.mapInPandas(digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
