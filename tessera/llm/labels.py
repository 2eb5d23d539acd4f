"""Bounded samples of labelled rows, which the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see: the checksum of the id as text is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drawn(rows: DataFrame, most: int, salt: str) -> DataFrame:
    """About ``most`` of the rows and never more, chosen by a hash of doc_id; all of them if there are fewer."""
    n = rows.count()
    if n <= most:
        return rows
    place = F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 31))
    # should the hash let more through than wanted, it also decides which ones stay
    return rows.where(place < int((1 << 31) * 0.97 * most / n)).orderBy(place, "doc_id").limit(most)


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, y of the rows a fit may see. An id with several labels has the largest; nulls are left out."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))
