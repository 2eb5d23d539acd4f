"""N-gram Jaccard join with Bayesian candidate pruning (after Satuluri and Parthasarathy's BayesLSH, 2012).

Equal texts become one class first. Classes whose MinHash bands meet in a bucket are compared in tiles of a bounded number
of classes: MinHash values are compared some at a time, and a pair is dropped as soon as the posterior probability
(uniform prior) that its similarity reaches the threshold falls below a tolerance. Pairs that stay are verified exactly
on the whole sets of shingles, in tiles too: the first pass keeps the members that have a partner left, the second finds
the pairs again beside the texts. Pairs exist only in the memory of a task, for one tile; a tile returns counts of links and
one link towards the least member of each of its clusters.

The chance that no band of a pair at the threshold meets is (1 - 0.8^5)^25, one in twenty thousand; above, far less.

Styles: signatures, tiles and verification are numpy on Arrow batches; buckets, counts, joins and components are
DataFrame functions.

Defined results: a null text is empty; equal texts are linked whatever they hold; other texts without words are linked with nothing; a text of
fewer than five words is one shingle; rows with the same doc_id are separate documents, each with the links of its own text; a
null doc_id has class null and no links; an empty table gives no rows; other columns are ignored. Texts are read whole; a tile holds about 2 x 4 million shingles
at most, so groups of long near copies are cut in more tiles, and only the sets of one tile and a range of their hashes are in memory. Ties of
similarity at the threshold count as links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import in_tiles, table, text_of, written
from tessera.llm.components import components
from tessera.llm.neardup_vectors import local_roots

WORDS, THRESHOLD = 5, 0.8
HASHES, BANDS, ROWS, STEP = 128, 25, 5, 16
TOLERANCE, TILE = 1e-6, 1024
#: Shingles of a chunk of a tile: what bounds a tile of long texts, as TILE bounds one of short texts. Elements that common() takes at a time.
CHUNK_SHINGLES, ELEMENTS = 4_000_000, 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of words."""
    tokens = text.split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = pd.util.hash_array(np.array(tokens, object), categorize=False)
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = _scrambled((out + h[k : k + n]) * np.uint64(2 * k + 3) + _MIX)
    return np.unique(out)


def _seeds(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1997)
    return rng.integers(1, 1 << 62, hashes, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 62, hashes, np.uint64)


def minhashes(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Top 32 bits of the least value under each of the hash functions (multiply, add, shift)."""
    out = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(s), 2048):
        part = s[at : at + 2048]
        out = np.minimum(out, ((part[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32))
    return out


def signatures(docs: DataFrame, words: int = WORDS, hashes: int = HASHES) -> DataFrame:
    """From doc_id, text: doc_id, x and y (hashes of the text), sig (bytes; null without words), size (shingles)."""

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _seeds(hashes)
        for pdf in batches:
            sig, size = [], []
            for t in pdf["text"]:
                s = shingles(t, words)
                sig.append(minhashes(s, a, b).astype("<u4").tobytes() if len(s) else None)
                size.append(len(s))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "x": pdf["x"], "y": pdf["y"], "sig": sig, "size": size})

    rows = docs.select("doc_id", text_of().alias("text")).withColumn("x", F.xxhash64("text")).withColumn("y", F.xxhash64(F.lit(1), "text"))
    return rows.mapInPandas(signed, "doc_id long, x long, y long, sig binary, size long")


def least_matches(threshold: float, hashes: int = HASHES, step: int = STEP, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches needed): with fewer, P(similarity >= threshold | matches) < tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and P(x >= t) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(step, hashes + 1, step):
        below, m = 0.0, 0
        while True:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def band(sig, k, rows: int = ROWS):
    return F.xxhash64(k, F.substring(sig, k * 4 * rows + 1, F.lit(4 * rows)))


def tiles(classes: DataFrame, bands: int = BANDS, rows: int = ROWS, tile: int = TILE, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """From id, sig, size: one row per member of a tile: t (band), bucket, a, b (its pair of chunks), chunk (the member's). A bucket has
    as many chunks as keep each to about ``tile`` members and ``chunk_shingles`` shingles."""
    each = classes.where("sig is not null").select("id", "size", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: band(F.col("sig"), k, rows))).alias("t", "bucket"))
    sizes = each.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"), F.min("id").alias("first"), F.bit_xor(F.xxhash64("id")).alias("who")).where("n > 1")
    # buckets of the same members: the earliest band has them
    sizes = sizes.groupBy("n", "first", "who").agg(F.min(F.struct("t", "bucket", "volume")).alias("k")).select("n", "k.t", "k.bucket", "k.volume")
    chunks = F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("volume") / chunk_shingles))
    member = each.join(sizes, ["t", "bucket"]).withColumn("chunks", chunks.cast("int"))
    member = member.withColumn("chunk", F.pmod(F.xxhash64("id", "bucket"), F.col("chunks")).cast("int"))
    spread = member.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return spread.select("id", "t", "bucket", "chunk", F.least("chunk", "o").alias("a"), F.greatest("chunk", "o").alias("b"))


def _pairs(key: tuple, c: dict, needs: list[tuple[int, int]], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a tile of the pairs that stay, each in the first band in which both meet."""
    t, a, b = key[0], key[2], key[3]
    sig = np.frombuffer(b"".join(c["sig"]), "<u4").reshape(len(c["sig"]), -1)
    left, right = np.flatnonzero(c["chunk"] == a), np.flatnonzero(c["chunk"] == b)
    kept = [(np.empty(0, np.int32),) * 2]
    for at in range(0, len(left), 64):
        i, j = (v.ravel() for v in np.meshgrid(left[at : at + 64], right, indexing="ij"))
        if a == b:
            keep = i < j
            i, j = i[keep], j[keep]
        same, done = np.zeros(len(i), np.int32), 0
        for n, m in needs:
            same += (sig[i, done:n] == sig[j, done:n]).sum(axis=1, dtype=np.int32)
            keep = same >= m
            i, j, same, done = i[keep], j[keep], same[keep], n
        for k in range(t):
            keep = (sig[i, k * rows : (k + 1) * rows] != sig[j, k * rows : (k + 1) * rows]).any(axis=1)
            i, j = i[keep], j[keep]
        kept.append((i.astype(np.int32), j.astype(np.int32)))
    i, j = (np.concatenate([p[k] for p in kept]) for k in (0, 1))
    return i, j


def surviving(classes: DataFrame, threshold: float, bands: int = BANDS, rows: int = ROWS, tile: int = TILE, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """From id, sig, size (a stored table): t, bucket, a, b, chunk, id of the members of tiles that have a partner after pruning."""
    needs = least_matches(threshold)

    def prune(key: tuple, c: dict) -> dict | None:
        i, j = _pairs(key, c, needs, rows)
        if not len(i):
            return None
        place = np.unique(np.concatenate([i, j]))
        n = len(place)
        return {"t": np.full(n, key[0]), "bucket": np.full(n, key[1]), "a": np.full(n, key[2]), "b": np.full(n, key[3]), "chunk": c["chunk"][place], "id": c["id"][place]}

    members = tiles(classes, bands, rows, tile, chunk_shingles).join(classes.select("id", "sig"), "id")
    return in_tiles(members, ["chunk", "id"], prune, "t int, bucket long, a int, b int, chunk int, id long")


def verified(candidates: DataFrame, texts: DataFrame, threshold: float, words: int = WORDS, rows: int = ROWS) -> DataFrame:
    """From surviving() and texts (id, copies, sig, text): per tile id, links (counting copies), towards (least id of its cluster there)."""
    needs = least_matches(threshold)

    def exact(key: tuple, c: dict) -> dict | None:
        i, j = _pairs(key, c, needs, rows)
        sets = []
        for k, t in enumerate(c["text"]):
            sets.append(shingles(t, words))
            c["text"][k] = None  # the set takes its place
        n = np.array([len(s) for s in sets])
        both = common(sets, i, j)
        near = both >= threshold * (n[i] + n[j] - both) - 1e-9
        i, j = i[near], j[near]
        if not len(i):
            return None
        ids, copies = c["id"], c["copies"]
        count = (np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))).astype(np.int64)
        hit = count > 0
        return {"id": ids[hit], "links": count[hit], "towards": local_roots(ids, i, j)[hit]}

    return in_tiles(candidates.join(texts, "id"), ["chunk", "id"], exact, "id long, links long, towards long")


def common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, columns: int = 8192, cells: int = 1 << 21, elements: int = ELEMENTS) -> np.ndarray:
    """The number of elements that the sorted sets i and j have in common, pair by pair. Elements are taken by ranges of hashes of about ``elements`` in all
    sets together; in a range sets become rows of bits, ``columns`` elements at a time, and pairs are counted ``cells`` words
    of bits at a time, so that memory doesn't depend on how many elements or pairs there are."""
    out = np.zeros(len(i), np.int64)
    ranges = -(-sum(len(s) for s in sets) // elements)
    cuts = np.array([(k << 64) // max(1, ranges) for k in range(1, ranges)], np.uint64)
    ends = [[0, *np.searchsorted(s, cuts).tolist(), len(s)] for s in sets]
    for k in range(ranges):
        _add_common(out, [s[e[k] : e[k + 1]] for s, e in zip(sets, ends, strict=True)], i, j, columns, cells)
    return out


def _add_common(out: np.ndarray, sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, columns: int, cells: int) -> None:
    _, inside, seen = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.cumsum(seen > 1) - 1
    keep = (seen > 1)[inside]
    owner, column = owner[keep], column[inside[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = int(column[-1]) + 1 if len(column) else 0
    columns = min(columns, -(-shared // 64) * 64)
    for at in range(0, shared, columns or 1):
        lo, hi = np.searchsorted(column, [at, at + columns])
        bits = np.zeros((len(sets), columns), bool)
        bits[owner[lo:hi], column[lo:hi] - at] = True
        bits = np.packbits(bits, axis=1).view(np.uint64)
        some = cells // bits.shape[1]
        for k in range(0, len(i), some):
            out[k : k + some] += np.bitwise_count(bits[i[k : k + some]] & bits[j[k : k + some]]).sum(axis=1, dtype=np.int64)


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, tile: int = TILE, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """From doc_id, text: doc_id, class_id (least doc_id that links reach), n_links (other documents of similarity at or above the threshold), one row per row."""
    return joined(docs, threshold, words, tile, chunk_shingles).select("doc_id", "class_id", "n_links")


def joined(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, tile: int = TILE, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """ngram_join() and x, y (hashes of the text) and node (a key of the group of linked texts). Classes have numbers of their own,
    because rows of one doc_id may hold different texts."""
    prints = written(signatures(docs, words), "signatures")
    classes = prints.where("doc_id is not null").groupBy("x", "y").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("size").alias("size"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "text-classes")
    left = written(surviving(classes.select("id", "sig", "size"), threshold, tile=tile, chunk_shingles=chunk_shingles), "candidates")
    wanted = left.select("id").distinct()
    texts = docs.select(F.col("doc_id").alias("least"), text_of().alias("text")).withColumn("x", F.xxhash64("text")).withColumn("y", F.xxhash64(F.lit(1), "text"))
    texts = texts.join(classes.join(wanted, "id", "left_semi"), ["least", "x", "y"]).select("id", "copies", "sig", "text").dropDuplicates(["id"])
    found = written(verified(left, texts, threshold, words), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    whole = components(found.select(F.col("id").alias("u"), F.col("towards").alias("v"))).withColumnRenamed("node", "id")
    known = classes.select("x", "y", "id", "copies", "least").join(counts, "id", "left").join(whole, "id", "left")
    firsts = known.where("component is not null").groupBy("component").agg(F.min("least").alias("first"))
    known = known.join(firsts, "component", "left")
    out = prints.select("doc_id", "x", "y").join(known, ["x", "y"], "left")
    null = F.col("doc_id").isNull()
    return out.select(
        "doc_id",
        F.when(~null, F.coalesce("first", "least")).alias("class_id"),
        F.when(null, F.lit(0)).otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        "x",
        "y",
        F.when(~null, F.coalesce("component", "id")).alias("node"),
    )


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
