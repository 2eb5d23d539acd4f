"""Labels and values moved along a flow (dx, dy per pixel)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import half_away, reflected


def pooled_flow(p: DataFrame) -> DataFrame:
    """Mean flow of each region, and its mean position moved by it."""
    return p.where("spix >= 0").groupBy("t", "spix").agg(F.avg("dx").alias("fx"), F.avg("dy").alias("fy"), (F.avg("x") + F.avg("dx")).alias("mx"), (F.avg("y") + F.avg("dy")).alias("my"))


def shifted_labels(p: DataFrame) -> DataFrame:
    """Every region moves as a whole by its rounded flow. Where several arrive, the region with fewest pixels wins, then the
    smaller id; where none does, the label is -1. One row per pixel of the raster: t, y, x, spix."""
    r = p.where("spix >= 0").groupBy("t", "spix").agg(half_away(F.avg("dx")).alias("fx"), half_away(F.avg("dy")).alias("fy"), F.count(F.lit(1)).alias("size"))
    moved = p.join(r, ["t", "spix"]).select("t", (F.col("y") + F.col("fy")).alias("y"), (F.col("x") + F.col("fx")).alias("x"), "spix", "size")
    won = moved.groupBy("t", "y", "x").agg(F.min(F.struct("size", "spix")).alias("best"))
    return p.select("t", "y", "x").join(won, ["t", "y", "x"], "left").select("t", "y", "x", F.coalesce("best.spix", F.lit(-1)).alias("spix"))


def shift_order(p: DataFrame) -> DataFrame:
    """For every place where some region arrives, on the raster or off it: t, y, x, arriving (how many regions), selected (the one that is shown: of fewest pixels, then the smaller number)."""
    r = p.where("spix >= 0").groupBy("t", "spix").agg(half_away(F.avg("dx")).alias("fx"), half_away(F.avg("dy")).alias("fy"), F.count(F.lit(1)).alias("size"))
    moved = p.join(r, ["t", "spix"]).select("t", (F.col("y") + F.col("fy")).alias("y"), (F.col("x") + F.col("fx")).alias("x"), "spix", "size")
    return moved.groupBy("t", "y", "x").agg(F.count(F.lit(1)).alias("arriving"), F.min(F.struct("size", "spix"))["spix"].alias("selected"))


CORNERS = ((0, 0), (0, 1), (1, 0), (1, 1))


def _corners(x: Column, y: Column, snap: float = 0.0) -> Column:
    """Array of (x, y, weight) of the four pixels around a point. A place within ``snap`` of a whole number is that number along its axis."""
    near = lambda v: F.when(F.abs(v - F.round(v)) < snap, F.round(v)).otherwise(v) if snap else v
    x, y = near(x), near(y)
    x0, y0 = F.floor(x), F.floor(y)
    fx, fy = x - x0, y - y0
    part = lambda f, k: f if k else F.lit(1.0) - f
    return F.array(*[F.struct((x0 + i).cast("int").alias("x"), (y0 + j).cast("int").alias("y"), (part(fx, i) * part(fy, j)).alias("w")) for j, i in CORNERS])


def splat(p: DataFrame, value: str, scale: float = 0.5, snap: float = 0.0) -> DataFrame:
    """Forward: each pixel adds its value, by bilinear weights, to the pixels around where it goes (x + scale dx, y + scale dy). Only pixels of the
    raster are returned: total and weight, 0 where nothing arrives."""
    gone = p.select("t", F.col(value).alias("_v"), F.explode(_corners(F.col("x") + F.col("dx") * scale, F.col("y") + F.col("dy") * scale, snap)).alias("_c")).where("_c.w > 0")
    sums = gone.groupBy("t", F.col("_c.y").alias("y"), F.col("_c.x").alias("x")).agg(F.sum(F.col("_v") * F.col("_c.w")).alias("total"), F.sum("_c.w").alias("weight"))
    return p.select("t", "y", "x").join(sums, ["t", "y", "x"], "left").select("t", "y", "x", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def warped(p: DataFrame, value: str, scale: float = 0.5) -> DataFrame:
    """Backward: each pixel reads, by bilinear weights, at x + scale dx, y + scale dy; outside the raster counts as 0."""
    at = p.select("t", F.col("y").alias("_y"), F.col("x").alias("_x"), F.explode(_corners(F.col("x") + F.col("dx") * scale, F.col("y") + F.col("dy") * scale)).alias("_c"))
    at = at.select("t", "_y", "_x", F.col("_c.y").alias("y"), F.col("_c.x").alias("x"), F.col("_c.w").alias("w")).where("w > 0")
    j = at.join(p.select("t", "y", "x", F.col(value).alias("_v")), ["t", "y", "x"], "left")
    return j.groupBy("t", F.col("_y").alias("y"), F.col("_x").alias("x")).agg(F.sum(F.coalesce("_v", F.lit(0)) * F.col("w")).alias("warped"))


def warped_reflected(p: DataFrame, value: str, width: int, scale: float = 0.5) -> DataFrame:
    """Backward as warped(), with places outside the raster mirrored at its border pixels."""
    tall = p.groupBy("t").agg((F.max("y") + 1).alias("_h"))
    at = p.join(tall, "t").select("t", F.col("y").alias("_y"), F.col("x").alias("_x"), F.explode(_corners(reflected(F.col("x") + F.col("dx") * scale, F.lit(width)), reflected(F.col("y") + F.col("dy") * scale, F.col("_h")))).alias("_c"))
    at = at.select("t", "_y", "_x", F.col("_c.y").alias("y"), F.col("_c.x").alias("x"), F.col("_c.w").alias("w")).where("w > 0")
    j = at.join(p.select("t", "y", "x", F.col(value).alias("_v")), ["t", "y", "x"], "left")
    return j.groupBy("t", F.col("_y").alias("y"), F.col("_x").alias("x")).agg(F.sum(F.coalesce("_v", F.lit(0)) * F.col("w")).alias("warped"))
