"""Ranks that are not made in one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.lineage import stored


def ranked(df: DataFrame, group: list[str], order: list[str], out: str, part_rows: int = 100_000, made: list[DataFrame] | None = None) -> DataFrame:
    """Adds ``out``: 0, 1, ... in each group along ``order``; group columns hold no nulls.

    Spark's range partitioning cuts the order of group and order columns into ranges of about ``part_rows`` rows, however many there are. The ranges are stored
    with their numbers, since another run of the same partitioning would cut elsewhere; counts of ranges give each its first rank in a group, a window inside a range the rest. made: gets the stored table, for a caller that knows when it may go."""
    ranges = -(-df.count() // part_rows) or 1
    cut = stored(df.repartitionByRange(ranges, *group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    if made is not None:
        made.append(cut)
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    first = cut.groupBy(*group, "_part").count().select(*group, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    local = F.row_number().over(W.partitionBy(*group, "_part").orderBy(*order))
    return cut.withColumn("_local", local).join(first, [*group, "_part"]).withColumn(out, F.col("_first") + F.col("_local") - 1).drop("_part", "_local", "_first")
