"""Segmentation quality. Each function gives one row, or one row per frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.neighbours import corner_edges, dilated, filtered
from tessera.operators.regions import CHANNELS, counts, counts_dense, pool_up


def temporal_extent(p: DataFrame) -> DataFrame:
    """tex: the share of (frame, label) cells that have pixels; labels run from 0 to the largest."""
    return counts_dense(p).agg(F.avg((F.col("count") > 0).cast("double")).alias("tex"))


def size_variation(p: DataFrame) -> DataFrame:
    """szv: standard deviation of a label's sizes over its frames, mean over labels alive in more than one; null if there are none."""
    per = counts(p).groupBy("spix").agg(F.stddev_samp("count").alias("sd"), F.count(F.lit(1)).alias("n"))
    return per.where("n > 1").agg(F.avg("sd").alias("szv"))


def explained_variation(p: DataFrame, over_time: bool = False) -> DataFrame:
    """ev per frame: variation of region means around the frame's mean, over the variation of pixels. Pooled per frame or over all frames."""
    pooled = pool_up(p, ("spix",) if over_time else ("t", "spix"))
    mean = p.groupBy("t").agg(*[F.avg(c).alias(f"g_{c}") for c in CHANNELS])
    j = pooled.join(mean, "t")
    sq = lambda a: sum((F.pow(F.col(f"{a}{c}") - F.col(f"g_{c}"), 2) for c in CHANNELS), F.lit(0.0))
    return j.groupBy("t").agg((F.sum(sq("m_")) / (F.sum(sq("")) + 1e-10)).alias("ev"))


def pooling_psnr(p: DataFrame) -> DataFrame:
    err = sum((F.pow(F.col(c) - F.col(f"m_{c}"), 2) for c in CHANNELS), F.lit(0.0)) / 3.0
    return pool_up(p).groupBy("t").agg((F.log10(F.avg(err)) * -10.0).alias("psnr"))


def gaussian(size: int = 11, sigma: float = 1.5) -> list[float]:
    import math

    w = [math.exp(-((k - size // 2) ** 2) / (2 * sigma * sigma)) for k in range(size)]
    return [v / sum(w) for v in w]


def similarity(p: DataFrame, a: str, b: str, peak: float = 1.0, size: int = 11) -> DataFrame:
    """t, ssim, cs: mean structural similarity per frame of two columns, over full windows, and its part of contrast and structure."""
    w = gaussian(size)
    parts = {"_ma": F.col(a), "_mb": F.col(b), "_aa": F.col(a) * F.col(a), "_bb": F.col(b) * F.col(b), "_ab": F.col(a) * F.col(b)}
    p = filtered(p.select("t", "y", "x", a, b), parts, w)
    m = {k: F.col(f"_{k}") for k in ("ma", "mb", "aa", "bb", "ab")}
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    cross, va, vb = m["ab"] - m["ma"] * m["mb"], m["aa"] - m["ma"] * m["ma"], m["bb"] - m["mb"] * m["mb"]
    value = (m["ma"] * m["mb"] * 2.0 + c1) * (cross * 2.0 + c2) / ((m["ma"] * m["ma"] + m["mb"] * m["mb"] + c1) * (va + vb + c2))
    return p.groupBy("t").agg(F.avg(value).alias("ssim"), F.avg((cross * 2.0 + c2) / (va + vb + c2)).alias("cs"))


def ssim(p: DataFrame, a: str, b: str, peak: float = 1.0, size: int = 11) -> DataFrame:
    return similarity(p, a, b, peak, size).select("t", "ssim")


def halved(p: DataFrame, values: list[str]) -> DataFrame:
    """Each frame at half its size: means of 2 x 2 pixels. An odd side has a line of zeros before its first and after its last line; a pixel that isn't there counts as 0."""
    size = p.groupBy("t").agg(((F.max("y") + 1) % 2).alias("_oy"), ((F.max("x") + 1) % 2).alias("_ox"))
    at = lambda c, odd: F.floor((F.col(c) + F.col(odd)) / 2).cast("int").alias(c)
    return p.join(size, "t").groupBy("t", at("y", "_oy"), at("x", "_ox")).agg(*[(F.sum(v) / 4.0).alias(v) for v in values])


#: The weights of the scales, finest first.
SCALES = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)


def ms_ssim(p: DataFrame, a: str, b: str, peak: float = 1.0, size: int = 11, weights: tuple[float, ...] = SCALES) -> DataFrame:
    """t, ms_ssim: the product over scales of contrast and structure, at the last scale of the whole similarity, negative ones as 0, each to its weight; null where a scale is smaller
    than the window. The scales are frames of one table, so one pass of windows measures all of them."""
    n = len(weights)
    q = p.select("t", "y", "x", F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    levels = q.withColumn("t", F.col("t") * n)
    for k in range(1, n):
        q = halved(q, ["a", "b"])
        levels = levels.unionByName(q.withColumn("t", F.col("t") * n + k))
    each = similarity(levels, "a", "b", peak, size).select(F.floor(F.col("t") / n).cast("int").alias("t"), (F.col("t") % n).alias("k"), "ssim", "cs")
    value = F.greatest(F.when(F.col("k") == n - 1, F.col("ssim")).otherwise(F.col("cs")), F.lit(0.0))
    one = [F.pow(F.max(F.when(F.col("k") == k, value)), w) for k, w in enumerate(weights)]
    out = one[0]
    for o in one[1:]:
        out = out * o
    # greatest() skips nulls, so a scale without windows is asked for by itself
    whole = F.count_if(F.col("cs").isNotNull()) == n
    return each.groupBy("t").agg(F.when(whole, out).alias("ms_ssim"))


def overlaps(p: DataFrame) -> DataFrame:
    """t, spix, gt, n (pixels of the label in the segment), size (of the label in the frame)."""
    inside = p.where("spix >= 0").groupBy("t", "spix", "gt").agg(F.count(F.lit(1)).alias("n"))
    return inside.join(counts(p).withColumnRenamed("count", "size"), ["t", "spix"])


def _frame(p: DataFrame) -> DataFrame:
    """One row: pixels of all frames, segments."""
    return p.groupBy("gt").count().agg(F.sum("count").alias("pixels"), F.count(F.lit(1)).alias("segments"))


def _over(value: DataFrame, p: DataFrame, total: Column, name: str) -> DataFrame:
    return value.crossJoin(_frame(p)).select((F.col("_v") / total).alias(name))


def underseg_2d(p: DataFrame) -> DataFrame:
    """ue2d: the smaller part of each label inside or outside a segment it meets, over the pixels; mean over frames and segments."""
    v = overlaps(p).agg(F.sum(F.least(F.col("n"), F.col("size") - F.col("n"))).alias("_v"))
    return _over(v, p, F.col("pixels") * F.col("segments"), "ue2d")


def underseg_3d(p: DataFrame) -> DataFrame:
    """ue3d: the same with parts summed over the frames in which both meet."""
    both = overlaps(p).groupBy("spix", "gt").agg(F.sum("n").alias("i"), F.sum(F.col("size") - F.col("n")).alias("o"))
    return _over(both.agg(F.sum(F.least("i", "o")).alias("_v")), p, F.col("pixels") * F.col("segments"), "ue3d")


def accuracy_2d(p: DataFrame) -> DataFrame:
    """sa2d: the share of a segment covered by labels that lie in it by half at least; mean over its frames, then over segments but the first."""
    first = p.agg(F.min("gt").alias("g0"))
    size = p.groupBy("t", "gt").agg(F.count(F.lit(1)).alias("whole"))
    hit = overlaps(p).where(F.col("n") >= F.col("size") * 0.5).groupBy("t", "gt").agg(F.sum("n").alias("hit"))
    per = size.join(hit, ["t", "gt"], "left").crossJoin(F.broadcast(first)).where("gt > g0")
    return per.groupBy("gt").agg(F.avg(F.coalesce("hit", F.lit(0)) / F.col("whole")).alias("a")).agg(F.avg("a").alias("sa2d"))


def accuracy_3d(p: DataFrame) -> DataFrame:
    """sa3d: the same with sizes summed over all frames."""
    first = p.agg(F.min("gt").alias("g0"))
    whole = p.groupBy("gt").agg(F.count(F.lit(1)).alias("whole"))
    total = p.where("spix >= 0").groupBy("spix").agg(F.count(F.lit(1)).alias("size"))
    part = p.where("spix >= 0").groupBy("spix", "gt").agg(F.count(F.lit(1)).alias("n")).join(total, "spix").where(F.col("n") >= F.col("size") * 0.5)
    per = whole.join(part.groupBy("gt").agg(F.sum("n").alias("hit")), "gt", "left").crossJoin(F.broadcast(first)).where("gt > g0")
    return per.agg(F.avg(F.coalesce("hit", F.lit(0)) / F.col("whole")).alias("sa3d"))


def underseg_legacy(p: DataFrame) -> DataFrame:
    """ue_legacy: (sizes of all labels that meet a segment - its size) / its size, mean over segments; over all frames."""
    whole = p.groupBy("gt").agg(F.count(F.lit(1)).alias("whole"))
    met = overlaps(p).groupBy("gt").agg(F.sum("size").alias("met"))
    return whole.join(met, "gt").agg(F.avg((F.col("met") - F.col("whole")) / F.col("whole")).alias("ue_legacy"))


def underseg_legacy_2d(p: DataFrame) -> DataFrame:
    """ue_legacy_2d: the same frame by frame, mean over segments and then over frames."""
    whole = p.groupBy("t", "gt").agg(F.count(F.lit(1)).alias("whole"))
    met = overlaps(p).groupBy("t", "gt").agg(F.sum("size").alias("met"))
    per = whole.join(met, ["t", "gt"]).groupBy("t").agg(F.avg((F.col("met") - F.col("whole")) / F.col("whole")).alias("u"))
    return per.agg(F.avg("u").alias("ue_legacy_2d"))


def label_losses(sims: DataFrame, p: DataFrame) -> DataFrame:
    """t, cross, compact per frame. From soft assignments (t, y, x, cand, p) and pixels (t, y, x, gt): cross, the mean of -log of the share that pooling over regions gives a pixel's own segment;
    compact, the mean squared distance of a pixel's place and its pooled place."""
    j = sims.select("t", "y", "x", "cand", "p").join(p.select("t", "y", "x", "gt"), ["t", "y", "x"])
    mass = j.groupBy("t", "cand").agg(F.sum("p").alias("_m"), *[(F.sum(F.col("p") * F.col(c)) / F.sum("p")).alias(f"_{c}") for c in ("y", "x")])
    share = j.groupBy("t", "cand", "gt").agg(F.sum("p").alias("_g"))
    j = j.join(share, ["t", "cand", "gt"]).join(mass, ["t", "cand"])
    per = j.groupBy("t", "y", "x").agg(F.sum(F.col("p") * F.col("_g") / F.col("_m")).alias("own"), *[F.sum(F.col("p") * F.col(f"_{c}")).alias(f"p{c}") for c in ("y", "x")])
    return per.groupBy("t").agg(F.avg(-F.ln(F.greatest("own", F.lit(1e-15)))).alias("cross"), F.avg(F.pow(F.col("py") - F.col("y"), 2) + F.pow(F.col("px") - F.col("x"), 2)).alias("compact"))


def underseg_frame(p: DataFrame, segment: int = 1) -> DataFrame:
    """ue per frame: for labels that meet the segment, pixels of label or segment that are not in both, over the pixels."""
    size = p.groupBy("t").agg(F.count(F.lit(1)).alias("npix"), F.count_if(F.col("gt") == segment).alias("whole"))
    return overlaps(p).where(F.col("gt") == segment).join(size, "t").groupBy("t").agg((F.sum(F.col("whole") + F.col("size") - F.col("n") * 2) / F.max("npix")).alias("ue"))


def achievable_accuracy(p: DataFrame) -> DataFrame:
    """asa per frame: pixels that labels get right when each takes its most frequent segment."""
    best = overlaps(p).groupBy("t", "spix").agg(F.max("n").alias("best")).groupBy("t").agg(F.sum("best").alias("best"))
    return best.join(p.groupBy("t").agg(F.count(F.lit(1)).alias("npix")), "t").select("t", (F.col("best") / F.col("npix")).alias("asa"))


def boundary_scores(p: DataFrame, radius: int = 1) -> DataFrame:
    """br, bp per frame: edges of segments near edges of labels, over edges of segments; over (dilated) edges of labels."""
    e = corner_edges(corner_edges(p, "spix", "_es"), "gt", "_eg").where("_es is not null")
    e = dilated(e, "_es", radius, "_near")
    return e.groupBy("t").agg((F.sum(F.col("_near") * F.col("_eg")) / F.sum("_eg")).alias("br"), (F.sum(F.col("_near") * F.col("_eg")) / F.sum("_near")).alias("bp"))


def entropy(sims: DataFrame) -> DataFrame:
    """Mean of -p log(p + 1e-15) over the rows of a frame."""
    return sims.groupBy("t").agg(F.avg(-F.col("p") * F.ln(F.col("p") + 1e-15)).alias("entropy"))


def residual(p: DataFrame) -> DataFrame:
    """Squared distance of a pixel to its region's mean, over the largest in the frame."""
    r = pool_up(p).withColumn("r", sum((F.pow(F.col(c) - F.col(f"m_{c}"), 2) for c in CHANNELS), F.lit(0.0)))
    most = r.groupBy("t").agg(F.max("r").alias("most"))
    return r.join(most, "t").select("t", "y", "x", (F.col("r") / F.col("most")).alias("residual"))
