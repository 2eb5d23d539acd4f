"""Neighbours of pixels on dense rasters, by windows along rows and columns. Outside the raster: null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EIGHT = ("nw", "n", "ne", "w", "e", "sw", "s", "se")


def along_row(frame: str = "t"):
    return W.partitionBy(frame, "y").orderBy("x")


def along_column(frame: str = "t"):
    return W.partitionBy(frame, "x").orderBy("y")


def four(df: DataFrame, value: str, prefix: str = "") -> DataFrame:
    """Adds n, s, w, e."""
    r, c = along_row(), along_column()
    return df.withColumns({f"{prefix}w": F.lag(value).over(r), f"{prefix}e": F.lead(value).over(r), f"{prefix}n": F.lag(value).over(c), f"{prefix}s": F.lead(value).over(c)})


def eight(df: DataFrame, value: str) -> DataFrame:
    """Adds nw, n, ne, w, e, sw, s, se. The last line of a frame may be short: what lies below is looked up from the pixels above it, side by side."""
    r, c = along_row(), along_column()
    df = df.withColumn("s", F.lead(value).over(c))
    df = df.withColumns({"w": F.lag(value).over(r), "e": F.lead(value).over(r), "sw": F.lag("s").over(r), "se": F.lead("s").over(r)})
    return df.withColumns({"n": F.lag(value).over(c), "nw": F.lag("w").over(c), "ne": F.lag("e").over(c)})


def border(df: DataFrame, label: str = "spix") -> DataFrame:
    """Adds border: at the edge of the raster, or a neighbour of the four has another label."""
    df = four(df, label, "_")
    differs = F.lit(False)
    for k in ("_n", "_s", "_w", "_e"):
        differs = differs | F.col(k).isNull() | (F.col(k) != F.col(label))
    return df.withColumn("border", differs).drop("_n", "_s", "_w", "_e")


def border_upper(df: DataFrame, label: str = "spix") -> DataFrame:
    """Adds border_end: a neighbour of the four has a smaller label, so a line between regions is one pixel wide."""
    df = four(df, label, "_")
    less = F.lit(False)
    for k in ("_n", "_s", "_w", "_e"):
        less = less | F.coalesce(F.col(k) < F.col(label), F.lit(False))
    return df.withColumn("border_end", less).drop("_n", "_s", "_w", "_e")


def dilated(df: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    """The largest value within a square, one axis after the other, in both orders: beside a short last line only one of them passes through pixels that are there."""
    r, c = along_row().rowsBetween(-radius, radius), along_column().rowsBetween(-radius, radius)
    df = df.withColumn("_wide", F.max(value).over(r))
    df = df.withColumns({"_both": F.max("_wide").over(c), "_tall": F.max(value).over(c)})
    return df.withColumn(out, F.greatest("_both", F.max("_tall").over(r))).drop("_wide", "_both", "_tall")


def corner_edges(df: DataFrame, label: str, out: str) -> DataFrame:
    """1 where the 2x2 block that starts here holds another label than its last pixel; rows without a full block go."""
    r, c = along_row(), along_column()
    df = df.withColumn("_pair", F.struct(F.col(label).alias("a"), F.lead(label).over(r).alias("b"))).withColumn("_under", F.lead("_pair").over(c))
    last = F.col("_under.b")
    differs = (F.col("_pair.a") != last) | (F.col("_pair.b") != last) | (F.col("_under.a") != last)
    return df.withColumn(out, differs.cast("int")).drop("_pair", "_under")


def simple_points() -> list[bool]:
    """For each byte of equality bits (bit i: neighbour i of EIGHT has the pixel's label): may the pixel leave its region without
    splitting it? True if the equal neighbours form at most one run of 4-connected steps around the pixel that holds a side neighbour."""
    ring = [0, 1, 2, 4, 7, 6, 5, 3]  # clockwise from the north-west
    sides = {1, 4, 6, 3}
    out = []
    for bits in range(256):
        on = [bool(bits >> i & 1) for i in ring]
        if all(on):
            out.append(False)
            continue
        start = next(k for k in range(8) if not on[k])
        runs, current = [], []
        for k in range(start + 1, start + 9):
            if on[k % 8]:
                current.append(ring[k % 8])
            elif current:
                runs.append(current)
                current = []
        runs = [r for r in [*runs, current] if sides & set(r)]
        out.append(len(runs) == 1)
    return out


def simple(df: DataFrame, label: str = "spix") -> DataFrame:
    """Adds bits (equal neighbours; off the raster counts as equal) and simple."""
    df = eight(df, label)
    bits = F.lit(0)
    for i, k in enumerate(EIGHT):
        bits = bits + F.when(F.coalesce(F.col(k) == F.col(label), F.lit(True)), 1 << i).otherwise(0)
    table = F.array(*[F.lit(v) for v in simple_points()])
    return df.withColumn("bits", bits).withColumn("simple", F.element_at(table, F.col("bits") + 1))


def filtered(df: DataFrame, values: dict[str, Column], weights: list[float]) -> DataFrame:
    """Adds separable filters of the values, without padding: at the first pixel of its square; null where the square leaves the raster.
    All values go through one window along rows and one along columns."""
    r, c = along_row(), along_column()
    line = lambda v, w: sum((F.lead(v, k).over(w) * x for k, x in enumerate(weights)), F.lit(0.0))
    df = df.withColumns({f"_v_{k}": v for k, v in values.items()})
    df = df.withColumns({f"_a_{k}": line(f"_v_{k}", r) for k in values}).drop(*[f"_v_{k}" for k in values])
    return df.withColumns({k: line(f"_a_{k}", c) for k in values}).drop(*[f"_a_{k}" for k in values])
