"""Document fingerprints by one-permutation MinHash.

A text's word shingles are hashed once; the top bits of a hash say its bin, each bin keeps its least hash. An empty bin
takes the value of the first filled bin in an order of its own, the same for all documents (optimal densification: each
bin probes the others at random, two bins independently). A fingerprint keeps the low byte of each value, packed as a
string of hex digits; likeness is the share of equal bytes with the chance of equal bytes taken out.

Native: DataFrame functions only.

Defined results: a null or wordless text has the empty fingerprint, which is 1 like another empty one and 0 like any other;
a text of fewer than five words is one shingle; rows that repeat a doc_id and its text count once in the order of
documents, others with the same doc_id follow a hash of their text; a null doc_id comes first; an empty table gives no
rows; other columns are ignored. Texts of any length are hashed whole; equal hashes in a bin are the same value, so ties need no order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import table, text_of, written

WORDS, BINS_LOG2, LOW_BITS = 5, 7, 8
BINS = 1 << BINS_LOG2
#: Rows of a range of the order of documents.
RANGE_ROWS = 250_000


def _mix64(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ x >> 31


def _probes() -> Column:
    """For each bin the order in which it asks the others: one literal, once Spark has folded it."""
    rows = [sorted((j for j in range(BINS) if j != i), key=lambda j: _mix64(i << 16 | j)) for i in range(BINS)]
    return F.from_json(F.lit(str(rows)), "array<array<int>>")


def with_fingerprint(df: DataFrame, text: str, out: str, words: int = WORDS) -> DataFrame:
    """Adds ``out``: array of BINS bytes (int), or null for a text without words.

    The greatest hash of every bin is added to the hashes before they are sorted, so that the first of each bin is its least
    hash, or says that the bin is empty. Columns that a lambda reads are used twice or more: Spark would copy a column used once into
    the lambda and compute it for each element."""
    keep = [F.col(f"`{c}`") for c in df.columns]
    df = df.withColumn("_h", F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    h = F.col("_h")
    n = F.size(h)
    shingle = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)])
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - words, F.lit(0))), shingle)
    rest = 64 - BINS_LOG2
    ends = F.array(*[F.lit((k - BINS // 2 << rest) + (1 << rest) - 1) for k in range(BINS)])
    df = df.withColumn("_s", F.sort_array(F.concat(F.when(n >= words, many).when(n > 0, F.array(F.xxhash64(h))), ends)))
    s = F.col("_s")
    least = F.filter(s, lambda x, i: (i == 0) | (F.shiftrightunsigned(x.bitwiseXOR(F.get(s, i - 1)), rest) != 0))
    empty = lambda x: x.bitwiseAND(F.lit((1 << rest) - 1)) == (1 << rest) - 1
    low = lambda x: x.bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("int")
    df = df.withColumn("_d", F.transform(least, lambda x: F.when(~empty(x), low(x))))
    d, probes = F.col("_d"), _probes()
    donor = lambda p: F.get(F.filter(F.get(probes, p), lambda j: F.get(d, j).isNotNull()), F.lit(0))
    dense = F.transform(d, lambda v, p: F.when(v.isNotNull(), v).otherwise(F.get(d, donor(p))))
    return df.select(*keep, F.when(F.size("_h") == 0, F.lit(None)).when(F.exists(d, F.isnull), dense).otherwise(d).alias(out))


def packed(values: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(values, lambda v: F.lower(F.lpad(F.hex(v), LOW_BITS // 4, "0"))), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard index, 0 to 1, from two columns of values. Both must be plain columns."""
    by_chance = 2.0**-LOW_BITS
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    j = F.greatest(F.lit(0.0), (same - by_chance) / (1 - by_chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(j)


def following(ids: DataFrame, rows_each: int = RANGE_ROWS) -> DataFrame:
    """From k, h (distinct, no nulls; a stored table): adds next_k, next_h of the row after it, of the first after the last one.

    Spark's range partitioning cuts the order into ranges of about ``rows_each`` rows, so each window sees a range; the heads of ranges, one row each, link them."""
    ranges = -(-ids.count() // rows_each) or 1
    rows = written(ids.repartitionByRange(ranges, "k", "h").select("*", F.spark_partition_id().alias("_cut"), F.struct("k", "h").alias("_me")), "ranges")
    heads = rows.groupBy("_cut").agg(F.min("_me").alias("_head"))
    chain = W.orderBy("_cut")
    heads = heads.select("_cut", F.coalesce(F.lead("_head").over(chain), F.first("_head").over(W.orderBy("_cut").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_after"))
    inside = W.partitionBy("_cut").orderBy("_me")
    out = rows.withColumn("_next", F.lead("_me").over(inside)).join(heads, "_cut")
    out = out.withColumn("_next", F.coalesce("_next", "_after"))
    return out.select(*ids.columns, F.col("_next.k").alias("next_k"), F.col("_next.h").alias("next_h"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    # keys without nulls, so that all joins deal the texts alike and their one exchange is used again
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("h"), "text")
    prints = with_fingerprint(docs, "text", "print").select("k", "h", F.col("doc_id").isNull().alias("no_id"), F.length("text").cast("long").alias("n_chars"), F.col("print").cast("array<smallint>").alias("print"))
    prints = written(prints, "prints")
    links = written(following(written(prints.select("k", "h", "n_chars").distinct(), "print-ids")), "links")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    heads = docs.select("k", "h", "text").join(links.select(F.col("next_k").alias("k"), F.col("next_h").alias("h"), F.col("k").alias("to_k"), F.col("h").alias("to_h"), "n_chars"), ["k", "h"])
    heads = heads.select(F.col("to_k").alias("k"), F.col("to_h").alias("h"), "n_chars", F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.substring("text", F.lit(1), quarter).alias("head")).dropDuplicates(["k", "h"])
    edited = docs.select("k", "h", "text").join(heads, ["k", "h"])
    edited = edited.select("k", "h", "n_chars", "next_k", "next_h", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.col("head")).alias("edited"))
    edited = with_fingerprint(edited, "edited", "edited_print").withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")
    one = prints.select("k", "h", "no_id", "print").dropDuplicates(["k", "h"])
    out = edited.join(one, ["k", "h"]).join(one.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.col("print").alias("next_print")), ["next_k", "next_h"])
    return out.select(
        F.when(~F.col("no_id"), F.col("k")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        packed(F.col("print")).alias("fingerprint"),
        packed(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
