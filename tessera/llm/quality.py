"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled text give the non-negative unbiased risk (Kiryo et al. 2017):
prior x R+(positives) + max(0, R-(unlabelled) - prior x R-(positives)), with the logistic loss, so a score is the probability
of label 1. No negative label is used. The class prior is the least ratio of unlabelled to positive mass above a threshold of a first
classifier of positives against unlabelled text (Scott 2015), by halves: a half's masses are those of the other half's classifier.

The score is a sum of step functions of measures of the whole text (word and line repetition, characters,
compressibility). Their steps (quantiles) and the unlabelled masses of the prior come from all documents that aren't held out; only the
gradient steps use samples, of at most ``FIT_ROWS`` trusted and as many unlabelled documents.

Styles: measures and the score are Python on Arrow batches, each text on its own; quantiles and masses are DataFrame aggregates;
the gradient steps are numpy on the driver.

Defined results: a null text is empty and has a score like any; repeated rows are scored each, and an id is in a sample once, with the least of its
rows' measures; a null doc_id isn't held out and never fitted on; an empty table gives no rows; without positives every score is 0.5, and if a half of the
sample lacks a class the prior is 0.5 (too few rows to estimate it); other columns are ignored. Texts of any length are measured whole; equal scores have no order, since each row is decided alone."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, written
from tessera.llm.labels import drawn, held_out, one_label

FIT_ROWS, STEPS, CUT = 15_000, 24, 0.3

_CLASSES = np.zeros((256, 7), np.float64)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"()-", "!", "|", "#$%&*@^~_=+<>/\\[]{}", " \t\n\r\x0b\x0c")):
    _CLASSES[[ord(c) for c in _chars], _k] = 1


def measures(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, size = max(1, len(words)), max(1, len(raw))
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / size
    each = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    twice = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x]
    ends = sum(x[-1] in ".!?" for x in lines)
    return [
        *share.tolist(),
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        len(each) / n**0.85,
        max(each.values(), default=0) / n,
        pairs / n,
        twice / n,
        np.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        ends / max(1, len(lines)),
        size / max(1, len(lines)) / 1000,
        len(zlib.compress(raw, 1)) / size,
        sum(w[-1] in ".,;:!?" for w in words) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.isalpha, words)) / n,
        sum(map(str.istitle, words)) / n,
    ]


N_MEASURES = 22


@dataclass
class Model:
    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(stepped(x, self.edges) @ self.weights + self.bias, -30, 30)))


def stepped(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One 0/1 column per measure and step: the measure is above the step."""
    return (x[:, :, None] > edges[None]).reshape(len(x), -1).astype(np.float32)


def _descend(grad, size: int, rounds: int = 400, rate: float = 0.05) -> np.ndarray:
    """Adam on (weights, bias)."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x times weights plus bias, in the precision of x, so that x isn't copied to doubles."""
    return (x @ w[:-1].astype(x.dtype)).astype(float) + w[-1]


def _back(g: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (g.astype(x.dtype) @ x).astype(float)


def _apart(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A plain logistic classifier of positives against unlabelled rows."""

    def grad(w: np.ndarray) -> np.ndarray:
        gp, gu = -_sigmoid(-_times(p, w)) / len(p), _sigmoid(_times(u, w)) / len(u)
        return np.append(_back(gp, p) + _back(gu, u) + 1e-3 * w[:-1], gp.sum() + gu.sum())

    return _descend(grad, p.shape[1] + 1, 200)


def thresholds(s: np.ndarray, least: float = 0.2, n: int = 60) -> np.ndarray:
    """Of scores of positives: quantiles that keep at least this share of them."""
    return np.quantile(s, np.linspace(0, 1 - least, n))


def estimated_prior(masses: list[tuple[np.ndarray, np.ndarray]]) -> float:
    """From the shares (unlabelled, positive) at or above the thresholds, one pair per half: the mean of the least ratios."""
    return float(np.clip(np.mean([np.min(u / np.maximum(p, 1e-9)) for u, p in masses]), 0.05, 0.95))


def fitted(p: np.ndarray, u: np.ndarray, edges: np.ndarray, prior: float, decay: float = 1e-4) -> Model:
    """From steps of positives and unlabelled rows."""

    def grad(w: np.ndarray) -> np.ndarray:
        zp, zu = _times(p, w), _times(u, w)
        pos, neg = -prior * _sigmoid(-zp) / len(p), -prior * _sigmoid(zp) / len(p)
        unl = _sigmoid(zu) / len(u)
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if risk < 0:  # the negative part went below zero: step back on it alone
            g = -(np.append(_back(unl, u), unl.sum()) + np.append(_back(neg, p), neg.sum()))
        else:
            g = np.append(_back(pos + neg, p) + _back(unl, u), pos.sum() + unl.sum() + neg.sum())
        g[:-1] += decay * w[:-1]
        return g

    w = _descend(grad, p.shape[1] + 1)
    return Model(edges, w[:-1], float(w[-1]), prior)


def measured(docs: DataFrame) -> DataFrame:
    """All columns of the documents and x, the measures of the text."""

    @F.pandas_udf("array<double>")
    def measure(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([measures(t or "") for t in some])

    return docs.withColumn("x", measure(F.col("text")))


def _half(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("half"), doc_id), F.lit(2)).cast("int")


def _edges(seen: DataFrame) -> np.ndarray:
    """Quantiles of every measure over all rows."""
    probs = [float(q) for q in np.linspace(0, 1, STEPS + 1)[:-1]]
    at = seen.agg(*[F.percentile_approx(F.get("x", F.lit(k)), probs, 10_000).alias(f"q{k}") for k in range(N_MEASURES)]).first()
    return np.array([list(q) for q in at])


def _masses(seen: DataFrame, edges: np.ndarray, first: list[np.ndarray], cuts: list[np.ndarray]) -> list[np.ndarray]:
    """Per half, the share of all its rows whose score by the other half's classifier is at or above each threshold."""

    @F.pandas_udf("double")
    def score(halves: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for half, x in halves:
            z = np.empty(len(x))
            for k in (0, 1):
                at = (half == k).to_numpy()
                if at.any():
                    z[at] = _times(stepped(np.stack(x.to_numpy()[at]), edges), first[1 - k])
            yield pd.Series(z)

    rows = seen.select(_half(F.col("doc_id")).alias("half"), "x").select("half", score("half", "x").alias("z"))
    above = [F.count(F.when(F.col("z") >= F.when(F.col("half") == 0, float(a)).otherwise(float(b)), 1)).alias(f"c{k}") for k, (a, b) in enumerate(zip(*cuts, strict=True))]
    got = {r["half"]: np.array(r[2:], float) / r["n"] for r in rows.groupBy("half").agg(F.count(F.lit(1)).alias("n"), *above).collect()}
    return [got.get(k, np.ones(len(cuts[k]))) for k in (0, 1)]


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model | None:
    """From documents (doc_id, x; a stored table, it is read several times) and labels (doc_id, quality); None without positives."""
    trusted = drawn(one_label(labels, "quality").where("y = 1").select("doc_id"), most, "trusted").withColumn("trusted", F.lit(True))
    seen = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "x")
    unlabelled = drawn(seen.select("doc_id").distinct(), most, "unlabelled").withColumn("trusted", F.lit(False))
    chosen = trusted.union(unlabelled)  # at most twice ``most`` ids
    rows = seen.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "trusted").agg(F.min("x").alias("x")).select("doc_id", "trusted", _half(F.col("doc_id")).alias("half"), "x").toPandas()
    rows = rows.sort_values(["doc_id", "trusted"])  # rows come in any order: the fit mustn't depend on it
    if not rows["trusted"].any():
        return None
    edges = _edges(seen)
    x, is_p, half = stepped(np.stack(rows["x"].to_numpy()), edges), rows["trusted"].to_numpy(bool), rows["half"].to_numpy()
    parts = [(x[is_p & (half == k)], x[~is_p & (half == k)]) for k in (0, 1)]
    if min(len(v) for pair in parts for v in pair) == 0:  # too few rows for an estimate
        return fitted(x[is_p], x[~is_p], edges, 0.5)
    first = [_apart(p, u) for p, u in parts]
    held = [_times(parts[k][0], first[1 - k]) for k in (0, 1)]
    cuts = [thresholds(s) for s in held]
    kept = [1 - np.searchsorted(np.sort(s), c, side="left") / len(s) for s, c in zip(held, cuts, strict=True)]
    prior = estimated_prior(list(zip(_masses(seen, edges, first, cuts), kept, strict=True)))
    return fitted(x[is_p], x[~is_p], edges, prior)


def scored(docs: DataFrame, model: Model | None, out: str = "score") -> DataFrame:
    """From documents with x: all columns and ``out``, the score."""

    @F.pandas_udf("double")
    def score(xs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in xs:
            yield pd.Series(np.full(len(x), 0.5) if model is None or not len(x) else model.score(np.stack(x.to_numpy())))

    return docs.withColumn(out, score(F.col("x")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = written(measured(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "measures")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
