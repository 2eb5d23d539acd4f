"""Long and wide tables of scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivoted(rows: DataFrame, index: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """One column per name, without aggregation: an index with the same name twice is an error."""
    twice = rows.groupBy(*index, name).count().where("count > 1").limit(1)
    if twice.count():
        raise ValueError(f"repeated {index} and {name}")
    return rows.groupBy(*index).pivot(name, names).agg(F.first(value))


def grid(*axes: DataFrame) -> DataFrame:
    """Every combination of the rows of small parameter tables."""
    return reduce(lambda a, b: a.crossJoin(b), axes)


def tiled_mean(p: DataFrame, value: str, size: int, step: int) -> DataFrame:
    """Every pixel goes to the tiles (of ``size``, every ``step``) that cover it, each tile is centred on its mean, and tiles are averaged where they overlap."""
    import math

    # tiles are made of cells, so all pixels of a cell lie in the same tiles; only cells are repeated for each tile
    side = math.gcd(size, step)
    first = lambda c: F.greatest(F.lit(0), F.floor((F.col(c) * side - size) / step) + 1)
    rows = p.select("t", "y", "x", F.col(value).alias("v"), *[F.floor(F.col(c) / side).alias(f"_c{c}") for c in "yx"])
    cells = rows.groupBy("t", "_cy", "_cx").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    each = cells.withColumn("ty", F.explode(F.sequence(first("_cy"), F.floor(F.col("_cy") * side / step)))).withColumn("tx", F.explode(F.sequence(first("_cx"), F.floor(F.col("_cx") * side / step))))
    mean = each.groupBy("t", "ty", "tx").agg((F.sum("s") / F.sum("n")).alias("m"))
    around = each.select("t", "_cy", "_cx", "ty", "tx").join(mean.hint("merge"), ["t", "ty", "tx"]).groupBy("t", "_cy", "_cx").agg(F.avg("m").alias("m"))
    return rows.join(around.hint("merge"), ["t", "_cy", "_cx"]).select("t", "y", "x", (F.col("v") - F.col("m")).alias("tiled"))


def to_unit_range(df: DataFrame, channels: list[str]) -> DataFrame:
    """All channels less their common minimum, divided by the maximum that is left (one row of extremes for the whole video)."""
    ends = df.agg(F.min(F.least(*channels)).alias("_lo"), F.max(F.greatest(*channels)).alias("_hi"))
    return df.crossJoin(F.broadcast(ends)).withColumns({c: (F.col(c) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) for c in channels}).drop("_lo", "_hi")


def to_byte_range(df: DataFrame, channels: list[str], image: str = "t") -> DataFrame:
    """Images whose largest value is below 200 hold 0..1 and are scaled to 0..255; others stay."""
    top = df.groupBy(image).agg(F.max(F.greatest(*channels)).alias("_top"))
    scaled = lambda c: F.when(F.col("_top") < 200, F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col(c) * 255.0))).otherwise(F.col(c))
    return df.join(top, image).withColumns({c: scaled(c) for c in channels}).drop("_top")


def complete_settings(results: DataFrame, setting: list[str], item: str) -> DataFrame:
    """The settings whose results cover as many different items as the fullest setting, and how many."""
    n = results.groupBy(*setting).agg(F.count_distinct(item).alias("items"))
    return n.crossJoin(F.broadcast(n.agg(F.max("items").alias("_most")))).where("items = _most").drop("_most")


def buffer_means(rows: DataFrame, keys: list[str]) -> DataFrame:
    """From a buffer of measurements (keys, metric, value): mean over the values that are there (neither null nor NaN; null if there are none), n of those, and n_all."""
    there = F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))
    return rows.groupBy(*keys, "metric").agg(F.avg(F.when(there, F.col("value"))).alias("mean"), F.count_if(there).alias("n"), F.count(F.lit(1)).alias("n_all"))


def frame_columns(rows: DataFrame, keys: list[str], metrics: list[str], frames: int) -> DataFrame:
    """From keys, frame, metric, value: one row per key with a column <metric>_<frame> for each metric and frame 0 to frames - 1; null where a value isn't there."""
    cell = lambda m, t: F.max(F.when((F.col("metric") == m) & (F.col("frame") == t), F.col("value"))).alias(f"{m}_{t}")
    return rows.groupBy(*keys).agg(*[cell(m, t) for m in metrics for t in range(frames)])
