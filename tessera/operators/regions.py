"""Counts, sums and means of labelled regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.order import ranked

CHANNELS = ("c0", "c1", "c2")


def counts(p: DataFrame, label: str = "spix") -> DataFrame:
    """Sizes of regions per frame; negative labels are missing pixels and don't count."""
    return p.where(F.col(label) >= 0).groupBy("t", label).agg(F.count(F.lit(1)).alias("count"))


def counts_dense(p: DataFrame, label: str = "spix") -> DataFrame:
    """A row for every frame and label from 0 to the largest, also where there are no pixels. One row per frame meets one
    generated sequence, so the only product is the result itself."""
    have = counts(p, label)
    top = have.agg(F.max(label).alias("top"))
    grid = p.select("t").distinct().join(F.broadcast(top)).select("t", F.explode(F.sequence(F.lit(0), F.col("top"))).alias(label))
    return grid.join(have, ["t", label], "left").select("t", label, F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def moments(p: DataFrame, label: str = "spix", squares: bool = False) -> DataFrame:
    """n, sums of channels and coordinates, and of the products of coordinates; with squares also of squared channels."""
    sums = {f"s_{c}": F.sum(c) for c in CHANNELS} | {"s_x": F.sum("x"), "s_y": F.sum("y"), "s_xx": F.sum(F.col("x") * F.col("x")), "s_xy": F.sum(F.col("x") * F.col("y")), "s_yy": F.sum(F.col("y") * F.col("y"))}
    if squares:
        sums |= {f"q_{c}": F.sum(F.col(c) * F.col(c)) for c in CHANNELS}
    return p.where(F.col(label) >= 0).groupBy("t", label).agg(F.count(F.lit(1)).alias("n"), *[v.cast("long").alias(k) for k, v in sums.items()])


def summary(m: DataFrame) -> DataFrame:
    """Means and covariances from moments."""
    n = F.col("n")
    mx, my = F.col("s_x") / n, F.col("s_y") / n
    return m.select("t", "spix", "n", *[(F.col(f"s_{c}") / n).alias(f"mu_{c}") for c in CHANNELS], mx.alias("mu_x"), my.alias("mu_y"), (F.col("s_xx") / n - mx * mx).alias("xx"), (F.col("s_xy") / n - mx * my).alias("xy"), (F.col("s_yy") / n - my * my).alias("yy"))


def map_update(now: DataFrame, prior: DataFrame) -> DataFrame:
    """From moments, and prior (t, spix, prior_count, p_xx, p_xy, p_yy): the smoothed covariance and its inverse. The prior's matrix is
    scaled by prior_count over the root of its determinant."""
    from tessera.functions.geometry import det, inverse, log_det, smoothed

    j = now.join(prior, ["t", "spix"])
    n, weight = F.col("n").cast("double"), F.col("prior_count")
    mx, my = F.col("s_x") / n, F.col("s_y") / n
    spread = [F.col("s_xx") - mx * mx * n, F.col("s_xy") - mx * my * n, F.col("s_yy") - my * my * n]
    p = [F.col("p_xx"), F.col("p_xy"), F.col("p_yy")]
    scale = weight / F.sqrt(F.greatest(det(*p), F.lit(1e-5)))
    cov = [smoothed(q * scale, s, weight, n) for q, s in zip(p, spread, strict=True)]
    j = j.select("t", "spix", "n", *[c.alias(k) for k, c in zip(("xx", "xy", "yy"), cov, strict=True)])
    c = [F.col(k) for k in ("xx", "xy", "yy")]
    return j.select("t", "spix", "n", *c, *[v.alias(f"i_{k}") for k, v in zip(("xx", "xy", "yy"), inverse(*c), strict=True)], log_det(*c).alias("logdet"))


def pool_down(p: DataFrame, keys: tuple[str, ...] = ("t", "spix"), eps: float = 0.0) -> DataFrame:
    """Means per region."""
    return p.where("spix >= 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), *[(F.sum(c) / (F.count(F.lit(1)) + eps)).alias(f"m_{c}") for c in CHANNELS])


def pool_up(p: DataFrame, keys: tuple[str, ...] = ("t", "spix")) -> DataFrame:
    """Each pixel gets its region's means. Means are aggregated before they are joined back, so a region of any size is no single task."""
    return p.join(pool_down(p, keys), list(keys))


def pool_backward(g: DataFrame, keys: tuple[str, ...] = ("t", "spix")) -> DataFrame:
    """Gradient of pooling: from g_up (of the pooled pixel) and g_down (of the region's mean, on each of its pixels once): each
    pixel gets (sum of g_up over its region + g_down) / count."""
    per = g.groupBy(*keys).agg(F.sum("g_up").alias("_up"), F.first("g_down").alias("_down"), F.count(F.lit(1)).alias("_n"))
    return g.join(per, list(keys)).withColumn("grad", (F.col("_up") + F.col("_down")) / F.col("_n")).drop("_up", "_down", "_n")


def soft_pool(sims: DataFrame) -> DataFrame:
    """From t, pix, spix, p, v: per pixel the sum over regions of p x (sum p v / sum p of the region)."""
    per = sims.groupBy("t", "spix").agg((F.sum(F.col("p") * F.col("v")) / F.sum("p")).alias("m"))
    return sims.join(per, ["t", "spix"]).groupBy("t", "pix").agg(F.sum(F.col("p") * F.col("m")).alias("pooled"))


def compact_ids(p: DataFrame, kept_below: int) -> DataFrame:
    """Old and new id: ids below ``kept_below`` stay, the others become kept_below, kept_below + 1, ... in order. Distinct ids only."""
    from tessera.operators.order import ranked

    new = p.select("spix").where(F.col("spix") >= kept_below).distinct().withColumn("_g", F.lit(0))
    return ranked(new, ["_g"], ["spix"], "rank").select("spix", (F.col("rank") + kept_below).cast("long").alias("new_spix"))


def factorize(p: DataFrame, label: str = "spix") -> DataFrame:
    """Labels numbered by first appearance in t, y, x."""
    from tessera.operators.order import ranked

    first = p.groupBy(label).agg(F.min(F.struct("t", "y", "x")).alias("at")).select(label, "at.*", F.lit(0).alias("_g"))
    return ranked(first, ["_g"], ["t", "y", "x"], "code").select(label, F.col("code").cast("long").alias("code"))


def rank_in_region(p: DataFrame, made: list[DataFrame] | None = None) -> DataFrame:
    """Adds rank, 0, 1, ... in the order of lines and columns; a region is cut in parts, so that none is ranked in one task."""
    return ranked(p, ["t", "spix"], ["y", "x"], "rank", made=made)


def child_offsets(sizes: DataFrame) -> DataFrame:
    """From t, spix, region, size: the largest component of a label has offset 0, the others follow by size, ties by region."""
    w = W.partitionBy("t", "spix").orderBy(F.desc("size"), "region")
    return sizes.withColumn("offset", F.row_number().over(w) - 1)


def mean_or(col: str, least: float = 0.0) -> Column:
    """The mean of the values that are not placeholders below ``least``."""
    return F.avg(F.when(F.col(col) >= least, F.col(col)))


def remapped(p: DataFrame, ids: DataFrame, label: str = "spix") -> DataFrame:
    """Labels replaced by ``new_spix`` of a table of ids; labels without one become -1."""
    return p.join(ids, label, "left").withColumn(label, F.coalesce("new_spix", F.lit(-1))).drop("new_spix")


def child_ids(sizes: DataFrame) -> DataFrame:
    """From t, spix, region, size: spix_new per component. The largest keeps its label; the others get numbers after the frame's largest label,
    label by label: an exclusive prefix sum over labels of the numbers of children, made over one row per label."""
    rows = child_offsets(sizes)
    per = rows.groupBy("t", "spix").agg((F.count(F.lit(1)) - 1).alias("extra"))
    before = W.partitionBy("t").orderBy("spix").rowsBetween(W.unboundedPreceding, -1)
    start = per.select("t", "spix", F.coalesce(F.sum("extra").over(before), F.lit(0)).alias("start"), F.max("spix").over(W.partitionBy("t")).alias("top"))
    j = rows.join(start, ["t", "spix"])
    return j.withColumn("spix_new", F.when(F.col("offset") == 0, F.col("spix")).otherwise(F.col("top") + F.col("start") + F.col("offset"))).drop("start", "top", "offset")


def beta_size_prior(sizes: DataFrame, whole: float, a: float = 2.0, b: float = 5.0) -> DataFrame:
    """Adds log_prior: the Beta log-density of each region's share of a frame. Spark has no log-gamma, but it is wanted for constants only."""
    import math

    norm = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    share = F.col("count") / whole
    return sizes.withColumn("log_prior", F.ln(share) * (a - 1) + F.ln(1.0 - share) * (b - 1) + norm)


def came_by_filling(p: DataFrame, shifted: DataFrame) -> DataFrame:
    """t, spix, n, n_invalid: a region's pixels, and those of them where the shifted labels (t, y, x, spix) had none."""
    before = shifted.select("t", "y", "x", (F.col("spix") < 0).alias("_gone"))
    return p.where("spix >= 0").join(before, ["t", "y", "x"]).groupBy("t", "spix").agg(F.count(F.lit(1)).alias("n"), F.count_if("_gone").alias("n_invalid"))


def compact_parameters(params: DataFrame, ids: DataFrame) -> DataFrame:
    """Region parameters (spix and any others) under their new ids; those without one keep theirs."""
    return params.join(ids, "spix", "left").withColumn("spix", F.coalesce("new_spix", "spix").cast("long")).drop("new_spix")
