"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words and the beginnings of longer words, hashed to 2^18 places; the fit keeps every place that
at least ``FEWEST`` rows of the sample hold, whatever it tells alone, since it may tell in a pair. score = sigmoid(bias + sum of weights + sum over pairs of terms of the product of
their factors), so a pair such as insult and group mention counts beyond its parts.

Styles: terms and the score are Python on Arrow batches, each text on its own; the fit is numpy on a bounded sample of
``FIT_ROWS`` labelled rows.

Defined results: a null text is empty and scores as one without terms; repeated rows are scored each; a null doc_id isn't held
out and never fitted on; an empty table gives no rows; if the labels have one class only, every score is that class's share
(smoothed); other columns are ignored. Texts are read whole, whatever their length; ties of the score have no order, since each row is decided alone."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.labels import drawn, held_out, one_label

FIT_ROWS, PLACES, FACTORS, START, CUT = 12_000, 1 << 18, 8, 5, 0.5
#: By three folds of the rows that a fit may see: area under the curve 0.994 on the 3,155 of 10,000 documents, 0.926 on the 329 of 1,000
#: (places of single rows kept: 0.991 and 0.895, with half the precision on the smaller one).
FEWEST = 3
#: Small steps for single terms that tell most, and larger ones from larger factors for labels that only pairs tell. Each fit tries both on four
#: fifths of its sample and takes the one that has the smaller loss on the other fifth.
SETTINGS = ({"epochs": 10, "rate": (0.05, 0.05), "spread": 0.01, "before": (1e-2, 0.1)}, {"epochs": 20, "rate": (0.05, 0.1), "spread": 0.03, "before": (1e-2, 1e-2)})
#: One chi-square in a thousand is larger by chance.
CHANCE = 10.8
WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> np.ndarray:
    """Places of the distinct terms."""
    words = set(WORD.findall(text.lower()))
    parts = words | {"^" + w[:START] for w in words if len(w) > START}
    crc = zlib.crc32
    return np.unique(np.fromiter((crc(w.encode("utf-8", "surrogatepass")) & PLACES - 1 for w in parts), np.int32, len(parts)))


@dataclass
class Model:
    column: np.ndarray  # of each place, or -1
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        return self.chances([terms(t) for t in texts])

    def chances(self, docs: list[np.ndarray]) -> np.ndarray:
        """Of texts by their places."""
        found = [self.column[d] for d in docs]
        found = [c[c >= 0] for c in found]
        cols = np.concatenate(found) if found else np.empty(0, np.int32)
        z = _forward(cols, np.array([len(c) for c in found], np.int64), self.bias, self.weights, self.factors)[0]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; an empty run has 0."""
    out = np.zeros((len(lengths), *values.shape[1:]), values.dtype)
    some = lengths > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[some], axis=0)
    return out


def _forward(cols: np.ndarray, lengths: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score before the sigmoid, and per row the sums of factors; cols holds the columns row after row."""
    sums = _sums(v[cols], lengths)
    return bias + _sums(w[cols] - 0.5 * (v * v).sum(axis=1)[cols], lengths) + 0.5 * (sums * sums).sum(axis=1), sums


def log_odds(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Of the presence of every place, smoothed, and drawn towards 0 the smaller its chi-square is: a start, which leaves no place out."""
    a, b = (np.bincount(np.concatenate([d for d, t in zip(docs, y, strict=True) if t == k] or [np.empty(0, np.int32)]), minlength=PLACES).astype(float) for k in (1, 0))
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    seen, gap = a + b, a * (n0 - b) - b * (n1 - a)
    chi = gap * gap * (n1 + n0) / np.maximum(seen * (n1 + n0 - seen) * max(1, n1 * n0), 1)
    return (np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))) * (chi / (chi + CHANCE)) ** 2


def chosen(docs: list[np.ndarray], y: np.ndarray) -> dict:
    """The better of the settings on a fifth of the sample, the same fifth in every run; the first ones where it lacks a class."""
    order = np.random.default_rng(13).permutation(len(y))
    apart, rest = order[: len(y) // 5], order[len(y) // 5 :]
    if min((y[some] == k).sum() for some in (apart, rest) for k in (0, 1)) < FEWEST:
        return SETTINGS[0]
    losses = []
    for s in SETTINGS:
        p = np.clip(fitted([docs[k] for k in rest], y[rest], **s).chances([docs[k] for k in apart]), 1e-6, 1 - 1e-6)
        losses.append(float(-np.where(y[apart] == 1, np.log(p), np.log(1 - p)).mean()))
    return SETTINGS[int(np.argmin(losses))]


def fitted(docs: list[np.ndarray], y: np.ndarray, epochs: int = 10, batch: int = 256, rate: tuple[float, float] = (0.05, 0.05), decay: float = 1e-2, start: float = 1.0, spread: float = 0.01, before: tuple[float, float] = (1e-2, 0.1), fewest: int = FEWEST) -> Model:
    """Adagrad on the logistic loss from the log odds; batches and start come from a fixed seed. A step touches only the
    columns of its batch. rate and before (the squares that adagrad starts from) hold for weights and for factors. Samples of all sizes have the same number of epochs."""
    often = np.bincount(np.concatenate([*docs, np.empty(0, np.int32)]), minlength=PLACES) >= fewest
    docs, keep = [d[often[d]] for d in docs], np.flatnonzero(often).astype(np.int32)
    column = np.full(PLACES, -1, np.int32)
    column[keep] = np.arange(len(keep), dtype=np.int32)
    rng = np.random.default_rng(11)
    share = (y.sum() + 1) / (len(y) + 2)
    bias, w, v = float(np.log(share / (1 - share))), (start * log_odds(docs, y)[keep]).astype(np.float32), rng.normal(0, spread, (len(keep), FACTORS)).astype(np.float32)
    if len(set(y.tolist())) < 2:
        return Model(column, bias, w * 0, v * 0)
    order = rng.permutation(len(y))
    batches = [_batch([column[docs[i]] for i in some], y[some]) for some in (order[at : at + batch] for at in range(0, len(y), batch))]
    both = np.vstack([w, v.T])  # a row of weights, then a row per factor: sums along rows are fast
    squares, pace = (np.array([k[0], *[k[1]] * FACTORS], np.float32)[:, None] for k in (before, rate))
    squares, gb = np.repeat(squares, len(keep), axis=1), before[0]
    # a column that few batches hold decays by as much per epoch as one that all hold
    fade = (decay * len(batches) / np.bincount(np.concatenate([b[0] for b in batches]), minlength=len(keep))).astype(np.float32)
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            own, inside, rows, target = batches[k]
            n, now = len(target), both[:, own]
            sums = np.stack([np.bincount(rows, f[inside], n) for f in now[1:]])
            z = bias + np.bincount(rows, (now[0] - 0.5 * (now[1:] ** 2).sum(axis=0))[inside], n) + 0.5 * (sums * sums).sum(axis=0)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
            d = np.stack([np.bincount(inside, h[rows], len(own)) for h in (g, *(g * sums))]).astype(np.float32)
            d[1:] -= d[0] * now[1:]
            d += fade[own] * now
            grown = squares[:, own] + d * d
            squares[:, own] = grown
            both[:, own] = now - pace * d / np.sqrt(grown)
            db = float(g.sum())
            gb += db * db
            bias -= rate[0] * db / gb**0.5
    return Model(column, bias, both[0], np.ascontiguousarray(both[1:].T))


def _batch(found: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Its distinct columns; of each term of each row, the place among them and the row; labels."""
    own, inside = np.unique(np.concatenate(found), return_inverse=True)
    return own, inside.astype(np.int32), np.repeat(np.arange(len(found), dtype=np.int32), [len(c) for c in found]), y


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    """From documents (doc_id, text) and labels (doc_id, toxic)."""
    sample = drawn(one_label(labels, "toxic"), most, "toxic")  # at most ``most`` rows

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "terms": [terms(t or "").astype("<i4").tobytes() for t in pdf["text"]]})

    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInPandas(read, "doc_id long, y int, terms binary")
    found = found.groupBy("doc_id").agg(F.min(F.struct("terms", "y")).alias("r")).select("doc_id", "r.y", "r.terms")
    rows = found.toPandas().sort_values("doc_id")
    places, y = [np.frombuffer(t, "<i4") for t in rows["terms"]], rows["y"].to_numpy(float)
    return fitted(places, y, **chosen(places, y))


def scored(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """All columns of the documents and ``out``, the score of their text."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series(model.score([t or "" for t in some]))

    return docs.withColumn(out, score(F.col("text")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
