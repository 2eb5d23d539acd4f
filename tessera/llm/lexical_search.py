"""Ranked lexical search without random access (NRA: Fagin, Lotem and Naor, 2003).

Documents are dealt to shards by a hash of their row, as many shards as keep the postings of each bounded. In a shard every term's postings lie by falling
impact. For each item the lists of its terms are read from the top, block by block; a document's score lies between what was read of it (lower) and
that plus, for each list in which it hasn't come yet, the impact that this list has reached (upper). Reading goes on until the k highest are
certain: no other document, read or not, can reach the k-th, or tie with it, and the scores of all that can are exact. A shard returns the k best of its documents, and
a window over those ranks them. A score doesn't depend on the shard; the counts of documents and terms are over all of them.

Styles: terms are counted, and lists are read, by Python (bytes, numpy) on Arrow batches; counts, impacts, shards and ranks are DataFrame functions.
A text first passes a table of 2^20 bits of the hashes of the items' terms (its size is fixed); the join with the terms themselves is
exact. Items are dealt to blocks, and each block meets each shard once, so that neither has to fit into memory whole.

Defined results: a null text has no terms, and neither counts nor is found; an item without known terms has no rows; rows that repeat a
doc_id are documents of their own and tie by it; a null doc_id comes last among ties; rows that repeat an item_id are items of their own;
empty tables give no rows; other columns are ignored. Texts are read whole, whatever their length."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import table, written

#: In UTF-8 the term pattern is digits, letters and all bytes from 0x80 on, since every other code point is excluded by it.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
K, BITS, SHARD_POSTINGS, BLOCK_TERMS = 10, 1 << 20, 1 << 20, 100_000
#: First block of a list; the next ones double what has been read.
DEPTH = 256


def terms(text: bytes) -> list[bytes]:
    """Of a text in UTF-8. bytes.lower() changes A-Z only."""
    return TERM.findall(text.lower())


def item_terms(items: DataFrame) -> DataFrame:
    """From item_id, text: item (a number of the row), item_id, term, times."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, d, w, n) for i, d, t in zip(*(b.column(k).to_pylist() for k in range(2)), b.column(2).cast(pa.binary()).to_pylist(), strict=True) for w, n in Counter(terms(t or b"")).items()]
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["item", "item_id", "term", "times"])

    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), "text")
    return numbered.mapInArrow(counted, "item long, item_id long, term binary, times long")


def known_bits(vocabulary: DataFrame) -> bytes:
    """One bit for each hash that a term has: 128 KB, however many terms there are."""
    places = vocabulary.select(F.crc32("term").bitwiseAND(F.lit(BITS - 1)).cast("int").alias("p")).distinct()
    bits = np.zeros(BITS, bool)
    bits[[r["p"] for r in places.collect()]] = True  # at most BITS rows
    return np.packbits(bits).tobytes()


def forward(docs: DataFrame, bits: bytes) -> DataFrame:
    """From doc_id, text: one row per document with a term: row, doc_id, n (terms with repeats), terms that the bits let through, and their occurrences."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, crc = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool).tolist(), zlib.crc32
        cache: dict[bytes, bool] = {}
        for b in batches:
            keep, n, words, times = [], [], [], []
            for k, t in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
                if not t or not (found := terms(t)):
                    continue
                some = []
                for w, c in Counter(found).items():
                    if (hit := cache.get(w)) is None:
                        hit = known[crc(w) & BITS - 1]
                        if len(cache) < 200_000:
                            cache[w] = hit
                    if hit:
                        some.append((w, c))
                keep.append(k)
                n.append(len(found))
                words.append([w for w, _ in some])
                times.append([c for _, c in some])
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(n, pa.int64()), pa.array(words, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))], ["row", "doc_id", "n", "terms", "times"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return numbered.mapInArrow(counted, "row long, doc_id long, n long, terms array<binary>, times array<int>")


def resolved(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, k: int = K, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """NRA over lists of (documents, impacts by falling size); documents are numbers below len(ids), which order ties.
    Returns the documents of the k highest scores above 0 (ties by id) and their scores."""
    lower, seen = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    read = [0] * len(lists)
    while True:
        for x, (docs, impacts) in enumerate(lists):
            to = min(len(docs), max(depth, 2 * read[x]))
            lower[docs[read[x] : to]] += impacts[read[x] : to]
            seen[docs[read[x] : to]] = True
            read[x] = to
        # what a list may still give to a document that hasn't come in it
        rest = [int(impacts[r]) if r < len(impacts) else 0 for (_, impacts), r in zip(lists, read, strict=True)]
        unread = sum(rest)
        some = np.flatnonzero(seen)
        if not unread:
            break  # all lists are read to the end: every score is exact
        if len(some) >= k:
            kth = np.partition(lower[some], len(some) - k)[len(some) - k]
            if unread < kth:
                upper = np.full(len(ids), unread, np.int64)
                for (docs, _), r, more in zip(lists, read, rest, strict=True):
                    if more:
                        upper[docs[:r]] -= more
                upper += lower
                open_ = some[upper[some] >= kth]  # may be among the k, or tie with the last
                if (upper[open_] == lower[open_]).all():
                    some = open_
                    break
    some = some[lower[some] > 0]
    if len(some) > k:  # those that tie with the last one stay until ids decide
        some = some[lower[some] >= np.partition(lower[some], len(some) - k)[len(some) - k]]
    some = some[np.lexsort((ids[some], -lower[some]))][:k]
    return some, lower[some]


def in_shard(postings: pd.DataFrame, asked: pd.DataFrame, k: int = K) -> pd.DataFrame:
    """The k best of a shard for each item of a block. postings: row, doc_id, tid, value; asked: item, item_id, tid, weight."""
    rows, first, doc = np.unique(postings["row"].to_numpy(), return_index=True, return_inverse=True)
    ids = postings["doc_id"].fillna(np.iinfo(np.int64).max).to_numpy(np.int64)[first]
    null = postings["doc_id"].isna().to_numpy()[first]
    tid, value = postings["tid"].to_numpy(), postings["value"].to_numpy(np.int64)
    order = np.lexsort((-value, tid))
    tid, value, doc = tid[order], value[order], doc[order].astype(np.int32)
    # rank of (id, null last, row), so that one number orders ties
    tie = np.empty(len(rows), np.int64)
    tie[np.lexsort((rows, null, ids))] = np.arange(len(rows))
    out = []
    for (item, item_id), some in asked.groupby(["item", "item_id"], dropna=False, sort=False):
        lists = []
        for t, w in zip(some["tid"].to_numpy(), some["weight"].to_numpy(np.int64), strict=True):
            lo, hi = np.searchsorted(tid, [t, t + 1])
            if hi > lo and w > 0:
                lists.append((doc[lo:hi], value[lo:hi] * w))
        found, scores = resolved(lists, tie, k)
        out += [(item, item_id, None if null[d] else int(ids[d]), int(rows[d]), int(s)) for d, s in zip(found.tolist(), scores.tolist(), strict=True)]
    return pd.DataFrame(out, columns=["item", "item_id", "doc_id", "row", "score"]).astype({"item": "int64", "item_id": "Int64", "doc_id": "Int64", "row": "int64", "score": "int64"})


def search(docs: DataFrame, items: DataFrame, k: int = K, shard_postings: int = SHARD_POSTINGS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """From docs (doc_id, text) and items (item_id, text): item_id, rank, doc_id, score."""
    asked = written(item_terms(items), "search-items")
    vocabulary = written(asked.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "search-terms")
    texts = written(forward(docs, known_bits(vocabulary)), "search-texts")
    total = texts.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    n, length = total["n"], total["l"] or 1
    each = texts.select("row", "doc_id", "n", F.explode(F.arrays_zip("terms", "times")).alias("p")).select("row", "doc_id", "n", F.col("p.terms").alias("term"), F.col("p.times").cast("long").alias("tf"))
    found = written(each.join(vocabulary, "term").drop("term"), "search-postings")
    df = found.groupBy("tid").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(n)) + 2) / (2 * F.col("df") + 1))).cast("long")
    known = written(df.select("tid", "df", weight.alias("w")), "search-weights")
    size = known.agg(F.sum("df").alias("n")).first()["n"] or 0
    shards = -(-size // shard_postings) or 1
    m = F.expr(f"25 + ((75 * n * {n}L) div {length}L)")
    found = found.withColumn("m", m).select("row", "doc_id", "tid", F.expr("(1000000000L * tf) div (1000 * tf + 8 * m)").alias("value"), F.pmod(F.xxhash64(F.lit("shard"), "row"), F.lit(shards)).cast("int").alias("shard"))
    rows = asked.join(vocabulary, "term").join(known, "tid").select("item", "item_id", "tid", (F.col("w") * F.col("times")).alias("weight"))
    blocks = -(-rows.count() // block_terms) or 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "item"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    if blocks > 1:
        found = found.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    else:
        found = found.withColumn("block", F.lit(0))

    def best(postings: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        return in_shard(postings, some, k)

    local = found.groupBy("shard", "block").cogroup(rows.groupBy("shard", "block")).applyInPandas(best, "item long, item_id long, doc_id long, row long, score long")
    place = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    return local.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
