"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.lineage import stored as written  # noqa: F401  cuts the lineage: the rows as a Parquet table in the shared folder, read again

#: Words are runs of anything but these characters.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def running_offsets(df: DataFrame, group: list[str], order: list[str], size: str, out: str, parts: Column) -> DataFrame:
    """Adds ``out``: the sum of ``size`` over the rows of the same group that come earlier.

    A group may hold most rows, so it is cut in parts (``parts`` must not decrease along the wanted order, or the order
    among parts is free): sums of parts first, then a window inside each part."""
    from pyspark.sql import Window as W

    cut = df.withColumn("_part", parts)
    sums = cut.groupBy(*group, "_part").agg(F.sum(size).alias("_sum"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*group, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "_part"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = cut.alias("l").join(starts.alias("r"), cond).select("l.*", "r._start")
    inside = W.partitionBy(*group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("_start") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("_part", "_start")


def in_tiles(rows: DataFrame, order: list[str], compare: Callable[[tuple, dict], dict | None], schema: str) -> DataFrame:
    """Applies ``compare`` to the rows of each tile (t, bucket, a, b), in ``order``; it gets the key and one array per column, and
    gives one array per column of ``schema`` or None. Tiles are bounded by whoever makes them; sorted partitions are
    read as a stream, so that very many small tiles cost no group each, and one tile at most is held over."""
    keys = ["t", "bucket", "a", "b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def done(pdf: pd.DataFrame, starts: list[int]) -> Iterator[pd.DataFrame]:
            cols = {c: pdf[c].to_numpy() for c in pdf.columns}
            found = []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if (out := compare(tuple(int(cols[k][lo]) for k in keys), {c: v[lo:hi] for c, v in cols.items()})) is not None:
                    found.append(out)
            if found:
                yield pd.DataFrame({c: np.concatenate([f[c] for f in found]) for c in found[0]})

        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            k = pdf[keys].to_numpy()
            starts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist()] if len(pdf) else [0]
            yield from done(pdf, starts)
            rest = pdf.iloc[starts[-1] :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield from done(rest, [0, len(rest)])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def hidden(docs: DataFrame) -> DataFrame:
    """All columns under names that no operator uses, so that columns of the same name can't clash."""
    return docs.withColumnsRenamed({c: f"doc__{c}" for c in docs.columns})


def shown(df: DataFrame, like: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``like`` from hidden ones, some replaced."""
    return same_schema(df.select(*[new.get(c, F.col(f"`doc__{c}`")).alias(c) for c in like.columns]), like)


def same_schema(df: DataFrame, like: DataFrame) -> DataFrame:
    """Columns and types of ``like``."""
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in like.schema.fields])


LONGS = T.ArrayType(T.LongType())
