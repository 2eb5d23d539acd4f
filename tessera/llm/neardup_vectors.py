"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine, connected components.

Equal vectors become one class first. Classes that share a bucket of some table are compared in tiles of a bounded number
of vectors, so a bucket of any size is a number of bounded tasks; a tile returns one row per vector (number of
links, one link towards the least member of its cluster), not its pairs. A pair is counted in the first table in which both
share a bucket. Buckets whose members are also those of a bucket in an earlier table are skipped.

Styles: the hash and the tiles are numpy on Arrow batches, the rest DataFrame functions.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are components of
their own; vectors link with vectors of their own length only; rows with the same vec_id are separate vectors, each with its own
links and component, and a component is named by its least vec_id; a null vec_id is kept with no links; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import in_tiles, table, written
from tessera.llm.components import components

TILE = 1024


def _planes(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng(20_240).standard_normal((dim, tables * bits)).astype(np.float32)


def signatures(vectors: DataFrame, tables: int, bits: int) -> DataFrame:
    """Adds buckets: array of one long per table, the signs of the products with its planes below the table's number."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for pdf in batches:
            keys = [None] * len(pdf)
            lengths = pdf["vector"].map(len).to_numpy()
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                x = np.stack(pdf["vector"].to_numpy()[at]).astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                signs = (x.astype(np.float32) @ _planes(int(n), tables, bits) > 0).reshape(len(at), tables, bits)
                codes = signs @ weights + (np.arange(tables, dtype=np.int64) << bits) + (np.int64(n) << 40)
                for i, c in zip(at, codes, strict=True):
                    keys[i] = c
            pdf["buckets"] = keys
            yield pdf[["id", "copies", "vector", "buckets"]]

    return vectors.mapInPandas(hashed, f"id long, copies long, vector {dict(vectors.dtypes)['vector']}, buckets array<long>")


def tiles(signed: DataFrame, tile: int = TILE) -> DataFrame:
    """One row per member of a tile: bucket, a, b (its pair of chunks), chunk (the member's), and the member."""
    each = signed.select("id", F.posexplode("buckets").alias("t", "bucket"))
    sizes = each.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.bit_xor(F.xxhash64("id")).alias("who")).where("n > 1")
    # buckets of the same members: the earliest table has them
    sizes = sizes.groupBy("n", "first", "who").agg(F.min(F.struct("t", "bucket")).alias("k")).select("n", "k.t", "k.bucket")
    chunks = F.ceil(F.col("n") / tile).cast("int")
    member = each.join(sizes, ["t", "bucket"]).withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("id", "bucket"), F.col("chunks")).cast("int"))
    spread = member.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return spread.select("id", "t", "bucket", "chunk", F.least("chunk", "o").alias("a"), F.greatest("chunk", "o").alias("b"))


def links(vectors: DataFrame, least: float, tables: int, bits: int, tile: int = TILE) -> DataFrame:
    """From id, copies, vector (array of double, finite, not zero): per id and tile id, links (counting copies), towards (least linked id of its cluster there)."""
    signed = written(signatures(vectors, tables, bits), "signed")
    members = tiles(signed, tile).join(signed, "id")

    def compare(key: tuple, c: dict) -> dict | None:
        t, a, b = key[0], key[2], key[3]
        x = np.stack(c["vector"]).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        ids, copies, chunk = c["id"], c["copies"], c["chunk"]
        left, right = np.flatnonzero(chunk == a), np.flatnonzero(chunk == b)
        pairs = []
        for at in range(0, len(left), 128):
            rows = left[at : at + 128]
            near = x[rows] @ x[right].T >= least
            if a == b:
                near &= rows[:, None] < right[None, :]
            i, j = np.nonzero(near)
            if len(i):
                pairs.append((rows[i].astype(np.int32), right[j].astype(np.int32)))
        if not pairs:
            return None
        i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        if t:  # counted where the pair met first
            earlier = np.stack(c["buckets"])[:, :t].astype(np.int64)
            for k in range(t):
                fresh = earlier[i, k] != earlier[j, k]
                i, j = i[fresh], j[fresh]
        count = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        hit = count > 0
        return {"id": ids[hit], "links": count[hit].astype(np.int64), "towards": local_roots(ids, i, j)[hit]} if len(i) else None

    return in_tiles(members, ["chunk", "id"], compare, "id long, links long, towards long")


def local_roots(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least id reachable within one tile over the pairs (i, j)."""
    root = ids.copy()
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == root).all():
            return root
        root = new


def shape(n: int, least: float, recall: float = 0.999) -> tuple[int, int]:
    """Bits and tables for n vectors: about one vector in sixteen shares a bucket by chance, and a pair just at the limit is found with this probability."""
    bits = max(8, math.ceil(math.log2(max(2, n))) + 4)
    same = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def near_duplicates(vectors: DataFrame, least: float = 0.95, tile: int = TILE) -> DataFrame:
    """From vec_id, vector: vec_id, n_links, component_id, one row per row."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.withColumn("good", F.coalesce(finite & F.col("vec_id").isNotNull(), F.lit(False)))
    key = F.when(F.col("good"), F.struct(F.xxhash64("vector").alias("x"), F.xxhash64(F.lit(1), "vector").alias("y")))
    rows = rows.withColumn("key", key)
    classes = rows.where("good").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    # a number of its own for each class: rows of one vec_id may hold different vectors
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    bits, tables = shape(classes.count(), least)
    found = written(links(classes.select("id", "copies", "vector"), least, tables, bits, tile), "vector-links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    whole = components(found.select(F.col("id").alias("u"), F.col("towards").alias("v")))
    known = classes.select("key", "id", "copies", "least").join(counts, "id", "left").join(whole.withColumnRenamed("node", "id"), "id", "left")
    firsts = known.where("component is not null").groupBy("component").agg(F.min("least").alias("first"))
    known = known.join(firsts, "component", "left")
    out = rows.select("vec_id", "key").join(known, "key", "left")
    return out.select(
        "vec_id",
        (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("first", "least", "vec_id").alias("component_id"),
    )


def op10_vector_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
