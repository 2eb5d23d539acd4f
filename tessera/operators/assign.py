"""Soft and hard assignment of pixels to regions with a bounded number of candidates each."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NINE = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def square_labels(x: Column, y: Column, size: int, width: int) -> Column:
    return (F.floor(y / size) * math.ceil(width / size) + F.floor(x / size)).cast("int")


def hexagon_labels(p: DataFrame, size: float, width: int) -> DataFrame:
    """t, y, x, spix: the nearest centre of a hexagonal grid for regions of size^2 pixels; ties go to the larger number.

    Rows of centres are 1.5 s apart, even rows shifted by half a cell; the nearest centre is among the 3 x 3 around."""
    s = math.sqrt(size * size / (1.5 * math.sqrt(3)))
    w, step = math.sqrt(3) * s, 1.5 * s
    across = int(width / w) + 2
    down = p.groupBy("t").agg(((F.max("y") + 1) / step).cast("int").alias("_rows")).withColumn("_rows", F.col("_rows") + 2)
    r0 = F.floor(F.col("y") / step + 0.5)
    each = p.select("t", "y", "x").join(down, "t").withColumn("_r", F.explode(F.array(*[(r0 + k) for k in (-1, 0, 1)])))
    shift = F.when(F.col("_r") % 2 == 0, w / 2).otherwise(0.0)
    c0 = F.floor((F.col("x") - shift) / w + 0.5)
    each = each.withColumn("_shift", shift).withColumn("_c", F.explode(F.array(*[(c0 + k) for k in (-1, 0, 1)])))
    each = each.where((F.col("_r") >= 0) & (F.col("_r") < F.col("_rows")) & (F.col("_c") >= 0) & (F.col("_c") < across))
    dx, dy = F.col("x") - (F.col("_c") * w + F.col("_shift")), F.col("y") - F.col("_r") * step
    number = (F.col("_r") * across + F.col("_c")).cast("int")
    return each.groupBy("t", "y", "x").agg(F.min_by(number, F.struct(dx * dx + dy * dy, -number)).alias("spix"))


def nine_candidates(p: DataFrame, size: int, width: int) -> DataFrame:
    """Every pixel nine times, once for each block around its own: t, y, x, channels, k (0..8), cand (-1 off the raster)."""
    across = math.ceil(width / size)
    tall = p.groupBy("t").agg(F.floor(F.max("y") / size).alias("_down"))
    by, bx = F.floor(F.col("y") / size), F.floor(F.col("x") / size)
    each = p.select("t", "y", "x", "c0", "c1", "c2").join(tall, "t").withColumn("_k", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, (dy, dx) in enumerate(NINE)])))
    r, c = by + F.col("_k.dy"), bx + F.col("_k.dx")
    ok = (r >= 0) & (r <= F.col("_down")) & (c >= 0) & (c < across)
    return each.select("t", "y", "x", "c0", "c1", "c2", F.col("_k.k").alias("k"), F.when(ok, r * across + c).otherwise(-1).cast("int").alias("cand"))


def block_means(p: DataFrame, size: int, width: int) -> DataFrame:
    q = p.withColumn("cand", square_labels(F.col("x"), F.col("y"), size, width))
    return q.groupBy("t", "cand").agg(*[F.avg(c).alias(f"m_{c}") for c in ("c0", "c1", "c2")])


def soft_assignment(p: DataFrame, means: DataFrame, size: int, width: int, sharp: float) -> DataFrame:
    """t, y, x, channels, k, cand, p: softmax of -sharp x squared colour distance over the blocks around a pixel's own. The means around a block are gathered in one row for it, so
    that a pixel meets one row and nothing is multiplied by nine before the result."""
    across = math.ceil(width / size)
    here = means.withColumns({"_r": F.floor(F.col("cand") / across), "_c": F.col("cand") % across})
    around = here.withColumn("_k", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, (dy, dx) in enumerate(NINE)])))
    r, c = F.col("_r") - F.col("_k.dy"), F.col("_c") - F.col("_k.dx")
    around = around.where((r >= 0) & (c >= 0) & (c < across)).select("t", (r * across + c).cast("int").alias("_block"), F.struct("_k.k", "cand", "m_c0", "m_c1", "m_c2").alias("m"))
    table = around.groupBy("t", "_block").agg(F.sort_array(F.collect_list("m")).alias("_all"))
    d = lambda m: sum((F.pow(F.col(c) - m[f"m_{c}"], 2) for c in ("c0", "c1", "c2")), F.lit(0.0))
    j = p.withColumn("_block", square_labels(F.col("x"), F.col("y"), size, width)).join(table, ["t", "_block"])
    j = j.withColumn("_e", F.transform("_all", lambda m: F.struct(m["k"].alias("k"), m["cand"].alias("cand"), F.exp(-d(m) * sharp).alias("e"))))
    j = j.withColumn("_s", F.aggregate("_e", F.lit(0.0), lambda s, m: s + m["e"]))
    # the sum is a column before the rows are made, else it would be made again for each of them
    j = j.select("t", "y", "x", "c0", "c1", "c2", "_s", F.explode("_e").alias("n"))
    return j.select("t", "y", "x", "c0", "c1", "c2", "n.k", "n.cand", F.when(F.col("_s") > 0, F.col("n.e") / F.col("_s")).otherwise(0.0).alias("p"))


@dataclass(frozen=True)
class Soft:
    """Soft regions of windows: blocks of ``size`` on frames of ``width``, ``sharp`` as in soft_assignment. Tasks get the blocks' means and make the assignments of their own pixels."""

    size: int
    width: int
    sharp: float

    @property
    def across(self) -> int:
        return math.ceil(self.width / self.size)

    def means(self, p: DataFrame, radius: int, span: int, block: int, frames: int, values: DataFrame | None = None) -> DataFrame:
        """The means of the blocks, for each group of _window_blocks those that its pixels may be assigned to. values: t, cand and more of blocks, which go along."""
        r, c = F.floor(F.col("cand") / self.across), F.col("cand") % self.across
        reach = lambda v: F.sequence(F.greatest(F.floor(((v - 1) * self.size - 2 * radius) / block), F.lit(0)), F.floor(((v + 2) * self.size - 1 + 2 * radius) / block))
        times = F.sequence(F.floor((F.col("t") - 2 * span) / frames), F.floor((F.col("t") + 2 * span) / frames))
        m = block_means(p, self.size, self.width)
        more = [k for k in values.columns if k not in ("t", "cand")] if values is not None else []
        m = m.join(values, ["t", "cand"]) if values is not None else m
        m = m.withColumn("bt", F.explode(times)).withColumn("by", F.explode(reach(r))).withColumn("bx", F.explode(reach(c)))
        return m.select("bt", "by", "bx", F.col("t").alias("t"), "cand", "m_c0", "m_c1", "m_c2", *more)

    def assigned(self, pdf: pd.DataFrame, means: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Candidates and probabilities of pixels, nine each; -1 and 0 off the raster."""
        t, y, x = (pdf[c].to_numpy().astype(np.int64) for c in "tyx")
        mt, mc = means["t"].to_numpy().astype(np.int64), means["cand"].to_numpy().astype(np.int64)
        t0, r0 = int(t.min()) - 1, int((y // self.size).min()) - 1
        grid = np.full((int(max(t.max(), mt.max(initial=t0))) - t0 + 2, int(max((y // self.size).max(), (mc // self.across).max(initial=r0))) - r0 + 3, self.across + 2, 3), np.nan)
        near = (mt > t0) & (mc // self.across >= r0)
        grid[mt[near] - t0, mc[near] // self.across - r0, mc[near] % self.across + 1] = means[["m_c0", "m_c1", "m_c2"]].to_numpy()[near]
        colours = pdf[["c0", "c1", "c2"]].to_numpy(float)
        cands, e = np.empty((len(t), 9), np.int64), np.empty((len(t), 9))
        for k, (dy, dx) in enumerate(NINE):
            r, c = y // self.size + dy, x // self.size + dx
            d = ((colours - grid[t - t0, r - r0, c + 1]) ** 2).sum(axis=1)
            cands[:, k] = np.where(np.isnan(d), -1, r * self.across + c)
            e[:, k] = np.where(np.isnan(d), 0.0, np.exp(-d * self.sharp))
        total = e.sum(axis=1, keepdims=True)
        return cands, np.divide(e, total, out=np.zeros_like(e), where=total > 0)


def soft_means(sims: DataFrame) -> DataFrame:
    return sims.groupBy("t", "cand").agg(*[(F.sum(F.col("p") * F.col(c)) / F.sum("p")).alias(f"m_{c}") for c in ("c0", "c1", "c2")])


def slic(p: DataFrame, size: int, width: int, sharp: float, rounds: int) -> DataFrame:
    """Soft assignments after some rounds of assignment and means."""
    from tessera.operators.lineage import cut

    p = p.select("t", "y", "x", "c0", "c1", "c2")
    sims = soft_assignment(p, block_means(p, size, width), size, width, sharp)
    for _ in range(rounds - 1):
        sims = soft_assignment(p, cut(soft_means(sims)), size, width, sharp)
    return sims


def best_label(sims: DataFrame) -> DataFrame:
    """The most probable candidate; ties: the smaller number."""
    return sims.groupBy("t", "y", "x").agg(F.max_by("cand", F.struct("p", -F.col("cand"))).alias("spix"))


def pairwise_softmax(vectors: DataFrame, centres: DataFrame, scale: float) -> DataFrame:
    """From (id, v) and (few rows: label, c): id, label, p: softmax over all centres of -scale x squared distance.

    Centres are one per label; they are gathered in one row whose size Spark may check before it broadcasts it."""
    table = centres.groupBy().agg(F.sort_array(F.collect_list(F.struct("label", "c"))).alias("all"))
    d = lambda c: F.aggregate(F.zip_with("v", c["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    j = vectors.crossJoin(table).withColumn("d", F.transform("all", lambda c: F.struct(c["label"].alias("label"), F.exp(-d(c) * scale).alias("e"))))
    j = j.withColumn("s", F.aggregate("d", F.lit(0.0), lambda s, x: s + x["e"]))
    return j.select("id", "s", F.explode("d").alias("d")).select("id", F.col("d.label").alias("label"), (F.col("d.e") / F.col("s")).alias("p"))


def same_region(sims: DataFrame) -> DataFrame:
    """For each pixel and its eastern neighbour: the probability that both are in one region (sum over common candidates of the product)."""
    right = sims.select("t", "y", (F.col("x") - 1).alias("x"), "cand", F.col("p").alias("q"))
    return sims.join(right, ["t", "y", "x", "cand"]).groupBy("t", "y", "x").agg(F.sum(F.col("p") * F.col("q")).alias("same"))


def gathered(sims: DataFrame, cands: DataFrame) -> DataFrame:
    """Nine probabilities per pixel in the order of candidates, 0 off the raster."""
    j = cands.select("t", "y", "x", "k").join(sims.select("t", "y", "x", "k", "p"), ["t", "y", "x", "k"], "left")
    return j.groupBy("t", "y", "x").agg(*[F.sum(F.when(F.col("k") == k, F.coalesce("p", F.lit(0.0))).otherwise(0.0)).alias(f"p{k}") for k in range(9)])


def region_weighted_mean(p: DataFrame, means: DataFrame, value: str, sharp: float) -> DataFrame:
    """3x3 convolution whose weights are each neighbour's likeness to the pixel's own region mean, normalised."""
    from tessera.operators.neighbours import EIGHT, eight

    q = eight(p, value).join(means.select("t", "spix", F.col(f"m_{value}").alias("_m")), ["t", "spix"])
    weight = lambda v: F.exp(-F.pow(v - F.col("_m"), 2) * sharp)
    cols = [F.col(value), *[F.col(k) for k in EIGHT]]
    top = sum((F.coalesce(weight(c) * c, F.lit(0.0)) for c in cols), F.lit(0.0))
    low = sum((F.coalesce(weight(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    return q.select("t", "y", "x", (top / (low + 1e-15)).alias("conv"))


def _window(p: DataFrame, value: str) -> tuple[DataFrame, list[Column]]:
    from tessera.operators.neighbours import EIGHT, eight

    return eight(p, value), [F.col(value), *[F.col(k) for k in EIGHT]]


def attention(p: DataFrame, value: str, scale: float) -> DataFrame:
    """Softmax over the 3x3 window of -scale x squared difference, applied to the values; outside the raster takes no part."""
    q, cols = _window(p, value)
    weight = lambda c: F.exp(-F.pow(c - F.col(value), 2) * scale)
    top = sum((F.coalesce(weight(c) * c, F.lit(0.0)) for c in cols), F.lit(0.0))
    low = sum((F.coalesce(weight(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    return q.select("t", "y", "x", (top / low).alias("attended"))


def region_attention(p: DataFrame, value: str, scale: float) -> DataFrame:
    """The same with weights kept inside the pixel's own region (hard labels)."""
    from tessera.operators.neighbours import EIGHT, eight

    q = eight(p.withColumn("_vl", F.struct(F.col(value).alias("v"), F.col("spix").alias("l"))), "_vl")
    cols = [F.col("_vl"), *[F.col(k) for k in EIGHT]]
    weight = lambda c: F.when(c["l"] == F.col("spix"), F.exp(-F.pow(c["v"] - F.col(value), 2) * scale)).otherwise(0.0)
    top = sum((F.coalesce(weight(c) * c["v"], F.lit(0.0)) for c in cols), F.lit(0.0))
    low = sum((weight(c) for c in cols), F.lit(0.0))
    return q.select("t", "y", "x", (top / low).alias("attended"))


def nearest_centres(p: DataFrame, centres: DataFrame, side: float) -> DataFrame:
    """From pixels (t, y, x, px, py: where they are looked for) and centres (t, spix, cx, cy), anywhere: t, y, x, spix of the nearest centre of the frame; ties go to the smaller number.
    Centres lie in cells of ``side`` pixels, so a pixel meets those around it only."""
    from tessera.operators.search import gap, ring_search

    code = F.col("y").cast("long") * (1 << 31) + F.col("x")
    points = p.select("t", code.alias("r"), F.col("px").cast("double").alias("u"), F.col("py").cast("double").alias("v"))
    targets = centres.select("t", F.col("spix").alias("q"), F.col("cx").cast("double").alias("u"), F.col("cy").cast("double").alias("v"))
    out = ring_search(points, targets, ["t"], 1, side, lambda x: gap(x, ("u", "v")), 1.0)
    return out.select("t", F.floor(F.col("r") / (1 << 31)).cast("int").alias("y"), (F.col("r") % (1 << 31)).cast("int").alias("x"), F.element_at("best", 1)["q"].cast("int").alias("spix"))


def _padded(column: pd.Series, fill: float, kind: type) -> np.ndarray:
    """Arrays of a few numbers each, as rows of one length."""
    n = column.str.len().to_numpy()
    out = np.full((len(n), max(n.max(initial=0), 1)), fill, kind)
    out[np.arange(out.shape[1]) < n[:, None]] = np.concatenate([np.asarray(v) for v in column]) if n.sum() else []
    return out


#: Frames of a group of windows: each pixel goes to (FRAMES + 4 span) / FRAMES groups.
FRAMES = 16


def _window_blocks(p: DataFrame, value: str, radius: int, span: int, block: int, *more: str) -> DataFrame:
    """Pixels once in every block that a window around them can reach into (bt, by, bx: FRAMES frames, lines and columns by ``block``), with the ends of the table in time and of their frame."""
    far, wide = 2 * radius, 2 * span
    last = p.agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    size = p.groupBy("t").agg(F.max("y").alias("y1"), F.max("x").alias("x1"))
    rows = p.select("t", "y", "x", F.col(value).cast("double").alias("v"), *more).join(size, "t").crossJoin(F.broadcast(last))  # one row
    reach = lambda c: F.sequence(F.greatest(F.floor((F.col(c) - far) / block), F.lit(0)), F.least(F.floor((F.col(c) + far) / block), F.floor(F.col(f"{c}1") / block)))
    times = F.sequence(F.floor(F.greatest(F.col("t") - wide, "t0") / FRAMES), F.floor(F.least(F.col("t") + wide, "t1") / FRAMES))
    return rows.withColumn("bt", F.explode(times)).withColumn("by", F.explode(reach("y"))).withColumn("bx", F.explode(reach("x")))


def _in_blocks(rows: DataFrame, work, schema: str, means: DataFrame | None = None) -> DataFrame:
    """work(key, pixels, means) for each group of _window_blocks; means: those of Soft, or None."""
    keys = ["bt", "by", "bx"]
    if means is None:
        return rows.groupBy(*keys).applyInPandas(lambda key, pdf: work(key, pdf, None), schema)
    empty = pd.DataFrame({f.split()[0]: [] for f in schema.split(", ")})
    # a block of means without pixels makes nothing
    return rows.groupBy(*keys).cogroup(means.groupBy(*keys)).applyInPandas(lambda key, pdf, m: work(key, pdf, m) if len(pdf) else empty, schema)


class _Block:
    """The windows of one block's pixels, place by place."""

    def __init__(self, key: tuple, pdf: pd.DataFrame, radius: int, span: int, block: int, shift: bool):
        bt, by, bx = (int(k) for k in key)
        t, y, x = (pdf[c].to_numpy() for c in "tyx")
        self.least = (int(t.min()), int(y.min()), int(x.min()))
        self.shape = tuple(int(a.max()) - b + 1 for a, b in zip((t, y, x), self.least, strict=True))
        self.row = np.full(self.shape, -1, np.int64)
        self.row[tuple(a - b for a, b in zip((t, y, x), self.least, strict=True))] = np.arange(len(pdf))
        self.own = np.flatnonzero((t // FRAMES == bt) & (y // block == by) & (x // block == bx))
        self.at = (t[self.own], y[self.own], x[self.own])
        start = lambda at, r, lo, hi: np.clip(at - r, lo, np.maximum(lo, hi - 2 * r)) if shift else at - r
        ends = [pdf[c].to_numpy()[self.own] for c in ("t0", "t1", "y1", "x1")]
        self.start = (start(self.at[0], span, ends[0], ends[1]), start(self.at[1], radius, 0, ends[2]), start(self.at[2], radius, 0, ends[3]))
        self.places = list(np.ndindex(2 * span + 1, 2 * radius + 1, 2 * radius + 1))

    def rows(self) -> Iterator[np.ndarray]:
        """For each place of the window the row of pdf that lies there, for all own pixels; -1 where there is none."""
        for d in self.places:
            at = [a + k - b for a, k, b in zip(self.start, d, self.least, strict=True)]
            there = np.all([(a >= 0) & (a < n) for a, n in zip(at, self.shape, strict=True)], axis=0)
            yield np.where(there, self.row[tuple(np.where(there, a, 0) for a in at)], -1)


def _alike(cands: np.ndarray, probs: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The probability that two pixels are in one region: the sum over common candidates of the product."""
    same = cands[own][:, :, None] == cands[other][:, None, :]
    return (np.where(same, probs[own][:, :, None] * probs[other][:, None, :], 0.0)).sum(axis=(1, 2))


def with_candidates(p: DataFrame, sims: DataFrame) -> DataFrame:
    """Adds cands and probs, arrays of the candidates of each pixel (a bounded number) in order and their probabilities."""
    each = sims.groupBy("t", "y", "x").agg(F.sort_array(F.collect_list(F.struct("cand", "p"))).alias("_c"))
    return p.join(each, ["t", "y", "x"]).withColumns({"cands": F.col("_c.cand"), "probs": F.col("_c.p")}).drop("_c")


def attention_windows(p: DataFrame, value: str, scale: float, radius: int, span: int = 0, same_region: bool = False, block: int = 32, soft: bool | Soft = False) -> DataFrame:
    """Attention over windows in time and space: t, y, x, attended: the mean of the values in the window, weighted by exp(-scale x squared difference). A window has 2 span + 1 frames and
    (2 radius + 1)^2 places; at a border it starts later or earlier, so that it stays whole where the raster is large enough. same_region: only pixels of the pixel's own region.
    soft: weights are times the probability that both pixels are in one region, from cands and probs (see with_candidates), or as a Soft says, from c0, c1 and c2.

    Pixels go once to every block that a window around them can reach into; each block, bounded by its side, its frames and the radius, is one group of arrays."""
    made = isinstance(soft, Soft)
    more = ["spix"] if same_region else ["c0", "c1", "c2"] if made else ["cands", "probs"] if soft else []
    rows = _window_blocks(p, value, radius, span, block, *more)

    def attended(key: tuple, pdf: pd.DataFrame, means: pd.DataFrame | None) -> pd.DataFrame:
        b = _Block(key, pdf, radius, span, block, True)
        values = pdf["v"].to_numpy()
        mine, top, low = values[b.own], np.zeros(len(b.own)), np.zeros(len(b.own))
        labels = pdf["spix"].to_numpy() if same_region else None
        cands, probs = soft.assigned(pdf, means) if made else (_padded(pdf["cands"], -1, np.int64), _padded(pdf["probs"], 0.0, float)) if soft else (None, None)
        for other in b.rows() if len(b.own) else ():
            there = other >= 0
            if same_region:
                there &= labels[other] == labels[b.own]
            w = np.where(there, np.exp(-scale * (values[other] - mine) ** 2), 0.0)
            if soft:
                w *= _alike(cands, probs, b.own, other)
            top += w * values[other]
            low += w
        t, y, x = b.at
        return pd.DataFrame({"t": t, "y": y, "x": x, "attended": top / (low + 1e-10 if soft else low)})

    return _in_blocks(rows, attended, "t int, y int, x int, attended double", soft.means(p, radius, span, block, FRAMES) if made else None)


def similarity_conv(p: DataFrame, value: str, kernel: list[list[float]], normal: str = "sum", renormalised: bool = True, block: int = 32, soft: Soft | None = None) -> DataFrame:
    """Convolution with a given odd kernel whose weights are times the probability that a neighbour is in the pixel's region (cands and probs, see with_candidates, or as soft says), which is
    divided by its sum or its maximum over the window (normal: sum or max). renormalised: weights are divided by the sum of their absolute values. Off the raster counts as 0."""
    if normal not in ("sum", "max"):
        raise ValueError("normal must be sum or max")
    weights = np.array(kernel, float)
    radius = len(weights) // 2
    if weights.shape != (2 * radius + 1, 2 * radius + 1):
        raise ValueError("kernels are square, with an odd side")
    rows = _window_blocks(p, value, radius, 0, block, *(("c0", "c1", "c2") if soft else ("cands", "probs")))

    def convolved(key: tuple, pdf: pd.DataFrame, means: pd.DataFrame | None) -> pd.DataFrame:
        b = _Block(key, pdf, radius, 0, block, False)
        t, y, x = b.at
        if not len(b.own):
            return pd.DataFrame({"t": t, "y": y, "x": x, "conv": []})
        values = pdf["v"].to_numpy()
        cands, probs = soft.assigned(pdf, means) if soft else (_padded(pdf["cands"], -1, np.int64), _padded(pdf["probs"], 0.0, float))
        others = list(b.rows())
        like = np.stack([np.where(o >= 0, _alike(cands, probs, b.own, o), 0.0) for o in others])
        like /= 1e-5 + (like.sum(axis=0) if normal == "sum" else like.max(axis=0))
        w = like * np.array([weights[d[1:]] for d in b.places])[:, None]
        if renormalised:
            w /= 1e-10 + np.abs(w).sum(axis=0)
        return pd.DataFrame({"t": t, "y": y, "x": x, "conv": (w * np.stack([values[o] for o in others])).sum(axis=0)})

    return _in_blocks(rows, convolved, "t int, y int, x int, conv double", soft.means(p, radius, 0, block, FRAMES) if soft else None)


def _looked_up(m: pd.DataFrame, keys: list[np.ndarray], have: list[str], *names: str) -> list[np.ndarray]:
    """Columns of m at keys; 0 where m has no such row."""
    at = pd.MultiIndex.from_frame(m[have])
    first = ~at.duplicated()
    i = at[first].get_indexer(pd.MultiIndex.from_arrays([k.ravel() for k in keys]))
    return [np.where(i >= 0, m[n].to_numpy()[first][i], 0.0).reshape(keys[0].shape) for n in names]


def _by_pixel(p: DataFrame, soft: Soft, work, schema: str, values: DataFrame | None = None, more: tuple[str, ...] = (), block: int = 32) -> DataFrame:
    """work(pixels, their nine candidates, their probabilities, means) for blocks of pixels, each pixel in one of them."""

    def made(_: tuple, pdf: pd.DataFrame, means: pd.DataFrame) -> pd.DataFrame:
        return work(pdf, *soft.assigned(pdf, means), means)

    rows = _window_blocks(p, "c0", 0, 0, block, "c0", "c1", "c2", *more).drop("t0", "t1", "y1", "x1")
    return _in_blocks(rows.drop("v"), made, schema, soft.means(p, 0, 0, block, FRAMES, values))


def _candidate_sums(pdf: pd.DataFrame, cands: np.ndarray, probs: np.ndarray, by: list[str], **values: np.ndarray) -> pd.DataFrame:
    """Sums of p x value over a group's pixels for each candidate (and the columns ``by``)."""
    there = cands.ravel() >= 0
    each = {c: np.repeat(pdf[c].to_numpy(), 9)[there] for c in by} | {"cand": cands.ravel()[there]}
    each |= {n: (probs * v[:, None]).ravel()[there] for n, v in values.items()}
    return pd.DataFrame(each).groupby([*by, "cand"], as_index=False, sort=False).sum()


def pooled(p: DataFrame, value: str, soft: Soft) -> DataFrame:
    """t, y, x, v (the value) and pooled: the sum over a pixel's candidates of p x (sum p v / sum p of the block). Pixels stay one row each; blocks' sums are added up in between."""

    def sums(pdf: pd.DataFrame, cands: np.ndarray, probs: np.ndarray, _: pd.DataFrame) -> pd.DataFrame:
        return _candidate_sums(pdf, cands, probs, ["t"], s=pdf[value].to_numpy(float), w=np.ones(len(pdf)))

    def result(pdf: pd.DataFrame, cands: np.ndarray, probs: np.ndarray, means: pd.DataFrame) -> pd.DataFrame:
        (m,) = _looked_up(means, [np.broadcast_to(pdf["t"].to_numpy()[:, None], cands.shape), cands], ["t", "cand"], "m")
        return pdf[["t", "y", "x"]].assign(v=pdf[value].astype(float), pooled=(probs * m).sum(axis=1))

    mean = _by_pixel(p, soft, sums, "t int, cand int, s double, w double").groupBy("t", "cand").agg((F.sum("s") / F.sum("w")).alias("m"))
    return _by_pixel(p, soft, result, "t int, y int, x int, v double, pooled double", mean)


def nine_shares(p: DataFrame, soft: Soft) -> DataFrame:
    """t, y, x, p0 to p8: nine probabilities per pixel in the order of candidates, 0 off the raster."""

    def shares(pdf: pd.DataFrame, _: np.ndarray, probs: np.ndarray, __: pd.DataFrame) -> pd.DataFrame:
        return pdf[["t", "y", "x"]].assign(**{f"p{k}": probs[:, k] for k in range(9)})

    return _by_pixel(p, soft, shares, "t int, y int, x int, " + ", ".join(f"p{k} double" for k in range(9)))


def label_losses(p: DataFrame, soft: Soft) -> DataFrame:
    """metrics.label_losses of the soft assignment itself: t, cross, compact. Pixels (t, y, x, channels, gt) stay one row each and meet the sums of the nine blocks around them; only sums per frame leave a block."""

    def sums(pdf: pd.DataFrame, cands: np.ndarray, probs: np.ndarray, _: pd.DataFrame) -> pd.DataFrame:
        return _candidate_sums(pdf, cands, probs, ["t", "gt"], g=np.ones(len(pdf)), sy=pdf["y"].to_numpy(float), sx=pdf["x"].to_numpy(float))

    def losses(pdf: pd.DataFrame, cands: np.ndarray, probs: np.ndarray, means: pd.DataFrame) -> pd.DataFrame:
        t, gt = (np.broadcast_to(pdf[c].to_numpy()[:, None], cands.shape) for c in ("t", "gt"))
        m, my, mx = _looked_up(means, [t, cands], ["t", "cand"], "m", "my", "mx")
        (g,) = _looked_up(means, [t, cands, gt], ["t", "cand", "gt"], "g")
        own = (probs * np.divide(g, m, out=np.zeros_like(g), where=m > 0)).sum(axis=1)
        off = ((probs * my).sum(axis=1) - pdf["y"]) ** 2 + ((probs * mx).sum(axis=1) - pdf["x"]) ** 2
        each = pd.DataFrame({"t": pdf["t"], "a": -np.log(np.maximum(own, 1e-15)), "b": off, "n": 1})
        return each.groupby("t", as_index=False).sum()

    part = _by_pixel(p, soft, sums, "t int, gt int, cand int, g double, sy double, sx double", more=("gt",)).groupBy("t", "cand", "gt").agg(*[F.sum(c).alias(c) for c in ("g", "sy", "sx")])
    mass = part.groupBy("t", "cand").agg(F.sum("g").alias("m"), (F.sum("sy") / F.sum("g")).alias("my"), (F.sum("sx") / F.sum("g")).alias("mx"))
    per = part.select("t", "cand", "gt", "g").join(mass, ["t", "cand"])
    return _by_pixel(p, soft, losses, "t int, a double, b double, n long", per, ("gt",)).groupBy("t").agg((F.sum("a") / F.sum("n")).alias("cross"), (F.sum("b") / F.sum("n")).alias("compact"))


def same_as_east(p: DataFrame, soft: Soft, block: int = 32) -> DataFrame:
    """t, y, x, same: for each pixel with an eastern neighbour the probability that both are in one region."""
    rows = _window_blocks(p, "c0", 1, 0, block, "c0", "c1", "c2")

    def alike(key: tuple, pdf: pd.DataFrame, means: pd.DataFrame) -> pd.DataFrame:
        b = _Block(key, pdf, 1, 0, block, False)
        east = next((o for d, o in zip(b.places, b.rows(), strict=True) if d == (0, 1, 2)), None)
        there = east >= 0
        t, y, x = (a[there] for a in b.at)
        cands, probs = soft.assigned(pdf, means)
        return pd.DataFrame({"t": t, "y": y, "x": x, "same": _alike(cands, probs, b.own[there], east[there])})

    return _in_blocks(rows, alike, "t int, y int, x int, same double", soft.means(p, 1, 0, block, FRAMES))


def present_pooled(p: DataFrame, means: DataFrame, sharp: float, block: int = 64) -> DataFrame:
    """t, y, x, present, pooled: how many regions are present in the pixel's frame, and their m_c0 pooled by the probabilities of present_softmax. Blocks of a frame meet its regions (a
    frame's are bounded) in one task, as arrays of pixels by regions, a bounded number of cells at once."""
    ends = p.groupBy("t").agg(F.floor(F.max("y") / block).alias("_y"), F.floor(F.max("x") / block).alias("_x"))
    rows = p.select("t", "y", "x", "c0", "c1", "c2", F.floor(F.col("y") / block).alias("by"), F.floor(F.col("x") / block).alias("bx"))
    each = means.join(ends, "t").withColumn("by", F.explode(F.sequence(F.lit(0), "_y"))).withColumn("bx", F.explode(F.sequence(F.lit(0), "_x")))
    each = each.select(F.col("t").alias("t"), F.col("by").cast("long").alias("by"), F.col("bx").cast("long").alias("bx"), "m_c0", "m_c1", "m_c2")

    def pooled_(pdf: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(m):
            pdf = pdf.iloc[:0]
        c, centres, out = pdf[["c0", "c1", "c2"]].to_numpy(float), m[["m_c0", "m_c1", "m_c2"]].to_numpy(float), np.empty(len(pdf))
        few = max(1, 1_000_000 // max(1, len(m)))
        for k in range(0, len(pdf), few):
            d = sum((c[k : k + few, i, None] - centres[None, :, i]) ** 2 for i in range(3))
            # the largest weight is taken out first, so no pixel has only zeros
            e = np.exp((d.min(axis=1, keepdims=True) - d) * sharp)
            out[k : k + few] = e @ centres[:, 0] / e.sum(axis=1)
        return pd.DataFrame({"t": pdf["t"], "y": pdf["y"], "x": pdf["x"], "present": np.full(len(pdf), len(m), np.int64), "pooled": out})

    keys = ["t", "by", "bx"]
    return rows.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInPandas(pooled_, "t int, y int, x int, present long, pooled double")


def present_softmax(p: DataFrame, means: DataFrame, sharp: float) -> DataFrame:
    """t, y, x, spix, p: softmax of -sharp x squared colour distance over all regions that are present in the pixel's frame; regions of other frames take no part. The means of a
    frame (t, spix, m_c0, m_c1, m_c2; a frame is bounded) are one row that its pixels meet, and the largest weight is taken out first, so no pixel has only zeros."""
    table = means.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("spix", "m_c0", "m_c1", "m_c2"))).alias("_all"))
    d = lambda m: sum((F.pow(F.col(c) - m[f"m_{c}"], 2) for c in ("c0", "c1", "c2")), F.lit(0.0))
    j = p.select("t", "y", "x", "c0", "c1", "c2").join(table, "t")
    j = j.withColumn("_d", F.transform("_all", lambda m: F.struct(m["spix"].alias("spix"), (-d(m) * sharp).alias("v"))))
    # the largest exponent and the sum in one pass: a column that a lambda refers to would be made again for each element
    more = lambda a, m: F.struct(F.greatest(a["top"], m["v"]).alias("top"), (a["sum"] * F.exp(a["top"] - F.greatest(a["top"], m["v"])) + F.exp(m["v"] - F.greatest(a["top"], m["v"]))).alias("sum"))
    j = j.withColumn("_n", F.aggregate("_d", F.struct(F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("sum")), more))
    j = j.select("t", "y", "x", "_n", F.explode("_d").alias("n"))
    return j.select("t", "y", "x", "n.spix", (F.exp(F.col("n.v") - F.col("_n.top")) / F.col("_n.sum")).alias("p"))


def principal_projection(rows: DataFrame, k: int) -> DataFrame:
    """From id, v (arrays of one length d): id, projected (k numbers): rows standardised over their own components, projected on the first k right singular vectors. Only the d x d sums of products reach the driver;
    each vector's largest component is made positive, since a singular vector has no sign of its own."""
    def standard(pdf: pd.DataFrame) -> np.ndarray:
        x = np.array(pdf["v"].tolist(), float)
        x = x - x.mean(axis=1, keepdims=True)
        return x / x.std(axis=1, ddof=1, keepdims=True)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                z = standard(pdf)
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pd.DataFrame({"a": range(len(total)), "s": total.tolist()})

    cells = rows.select("v").mapInPandas(products, "a int, s array<double>").select("a", F.posexplode("s").alias("b", "x"))
    sums = cells.groupBy("a", "b").agg(F.sum("x").alias("s")).collect()  # d x d rows
    d = max((r["b"] for r in sums), default=-1) + 1
    gram = np.zeros((d, d))
    for r in sums:
        gram[r["a"], r["b"]] = r["s"]
    axes = np.linalg.eigh(gram)[1][:, ::-1][:, :k] if d else np.zeros((0, 0))
    if d:
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])

    def projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "projected": (standard(pdf) @ axes).tolist()})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "v").mapInPandas(projected, f"id {kind}, projected array<double>")
