"""Random patches and noise that come out the same in every run and on every executor: a number depends on the seed and on what it is for, never on where it is made."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(seed: int, *what: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of the seed and what it is for."""
    name = F.concat_ws(":", F.lit(str(seed)), *[w.cast("string") if isinstance(w, Column) else F.lit(w) for w in what])
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def gaussian(seed: int, *what: Column | str) -> Column:
    """A standard normal number (Box and Muller)."""
    u, v = uniform(seed, "u", *what), uniform(seed, "v", *what)
    return F.sqrt(F.ln(1.0 - u) * -2.0) * F.cos(v * (2 * math.pi))


def noisy(p: DataFrame, channels: list[str], sigma: float, seed: int) -> DataFrame:
    """Adds normal noise to the channels of each pixel."""
    return p.withColumns({c: F.col(c) + gaussian(seed, c, F.col("t"), F.col("y"), F.col("x")) * sigma for c in channels})


def patches(p: DataFrame, size: int, repeats: int, seed: int) -> DataFrame:
    """Square patches of each frame: its columns with y and x in the patch, and patch (0 to repeats - 1). Place, flips and transposition are drawn by frame and patch; a frame
    smaller than a patch gives none. One row per frame meets its pixels, so nothing but the patches themselves is multiplied."""
    key = F.col("t"), F.col("patch")
    frames = p.groupBy("t").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w")).where(F.least("_h", "_w") >= size)
    frames = frames.withColumn("patch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    start = lambda n, what: F.floor(uniform(seed, what, *key) * (F.col(n) - size + 1)).cast("int")
    coin = lambda what: uniform(seed, what, *key) < 0.5
    frames = frames.select("t", "patch", start("_h", "top").alias("_top"), start("_w", "left").alias("_left"), coin("flip_y").alias("_fy"), coin("flip_x").alias("_fx"), coin("turn").alias("_turn"))
    q = p.join(frames, "t").where((F.col("y") >= F.col("_top")) & (F.col("y") < F.col("_top") + size) & (F.col("x") >= F.col("_left")) & (F.col("x") < F.col("_left") + size))
    y, x = F.col("y") - F.col("_top"), F.col("x") - F.col("_left")
    y, x = F.when(F.col("_fy"), size - 1 - y).otherwise(y), F.when(F.col("_fx"), size - 1 - x).otherwise(x)
    q = q.withColumns({"_y": F.when(F.col("_turn"), x).otherwise(y), "_x": F.when(F.col("_turn"), y).otherwise(x)})
    return q.select(*[F.col(f"_{c}").alias(c) if c in ("y", "x") else c for c in p.columns], "patch")
