"""Sharding by sampled splitters: size-weighted samples of keys give quantile boundaries, records are dealt by range, and
where a range is overfull it is divided further.

Native: DataFrame functions only. The key is (hash of the text, doc_id): equal texts lie together, and a group of copies
is itself divisible, because doc_id tells its members apart. Law: ``bytes`` - the sizes of the shards differ by about one record.

The driver sees the splitters alone, one for about ``RANGE_ROWS`` records (at least ``RANGES``, at most ``MOST_RANGES``). Records of a range
are put in order in one window; ranges that hold more than ``overfull`` times their share (sampling error, one very large group) are
subdivided by a second hash into as many parts as it takes, so no window grows with a group; rows that repeat a doc_id and its text
have a number of their own, which divides them too.

Defined results: a null text has size 1 and the crc of the empty text; null ids come first; repeated rows are records of
their own; an empty table gives no rows; other columns are ignored. A text of any length is one record, measured whole; records of equal keys
are ordered by doc_id and then by their place in the stored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import table, text_of, written

#: Least and most ranges, records that a range should hold, and sampled keys for each boundary between ranges.
RANGES, MOST_RANGES, RANGE_ROWS, SAMPLES_EACH = 256, 65_536, 100_000, 24
#: Boundaries that one expression compares.
TREE = 256


def splitters(records: DataFrame, ranges: int = RANGES, samples_each: int = SAMPLES_EACH) -> list[int]:
    """Quantile boundaries of ``key`` by size. A key is drawn once for each time a multiple of total / wanted falls into
    its stretch of sizes in expectation (Poisson with the rate size x wanted / total, the coin a hash of key and tie)."""
    total = records.agg(F.sum("size").alias("n")).first()["n"] or 0
    if not total:
        return []
    wanted = ranges * samples_each
    rate = F.col("size") * (wanted / total)
    coin = F.pmod(F.xxhash64(F.lit("draw"), "key", "tie"), F.lit(1 << 52)) / float(1 << 52)
    times = F.floor(rate) + F.when(coin < rate - F.floor(rate), 1).otherwise(0)
    drawn = records.select("key", times.alias("times")).where("times > 0")
    probs = [k / ranges for k in range(1, ranges)]
    got = drawn.select(F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_"), "key").agg(F.percentile_approx("key", probs, 10 * ranges).alias("at")).first()["at"]
    return sorted(set(got or []))


def range_of(key: Column, bounds: list[int]) -> Column:
    """The number of boundaries at or below the key: by halving, as one expression; many boundaries are a literal of equal runs, of
    which halving finds one, and a count inside that run the rest."""
    if len(bounds) > TREE:
        each = max(TREE, -(-len(bounds) // TREE))
        runs = [bounds[k : k + each] for k in range(0, len(bounds), each)]
        run = range_of(key, [r[0] for r in runs[1:]])
        inside = F.size(F.filter(F.get(F.from_json(F.lit(str(runs)), "array<array<bigint>>"), run), lambda b: b <= key))
        return (run * each + inside).cast("int")

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < bounds[mid], pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return pick(0, len(bounds))


def shard(records: DataFrame, shards: int, ranges: int = RANGES, overfull: float = 1.5, whole: int = 50) -> DataFrame:
    """From key (long), tie (any order), size (long > 0) and other columns: adds shard (int) and slot (long).

    Records of one key stay together unless they hold more than 1 / ``whole`` of a shard: a boundary moves by half of a whole group at most, so
    shards are equal to 1 / ``whole`` and a record. At most shards x whole keys can be larger, so the list of those is bounded and broadcast."""
    names = records.columns
    records = written(records.withColumn("_row", F.monotonically_increasing_id()), "shard-records")
    ranges = max(ranges, min(MOST_RANGES, -(-records.count() // RANGE_ROWS)))
    bounds = splitters(records, ranges)
    grand = records.agg(F.sum("size").alias("_total"), F.count(F.lit(1)).alias("_n"))
    large = records.groupBy("key").agg(F.sum("size").alias("_bytes")).crossJoin(F.broadcast(grand)).where(F.col("_bytes") * shards * whole > F.col("_total")).select("key", F.lit(True).alias("_large"))
    dealt = records.join(F.broadcast(large), "key", "left").withColumn("_range", range_of(F.col("key"), bounds))
    dealt = dealt.withColumn("_apart", F.when(F.col("_large"), F.xxhash64("tie", "_row")))
    per = dealt.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows")).crossJoin(F.broadcast(grand))
    # an overfull range becomes _cuts parts, dealt by a hash of the key, for large groups of the tie
    share = F.greatest(F.col("_bytes") / F.col("_total"), F.col("_rows") / F.col("_n")) * ranges
    per = per.select("_range", F.greatest(F.lit(1), F.ceil(share / overfull)).cast("int").alias("_cuts"))
    part = F.when(F.col("_cuts") > 1, F.pmod(F.coalesce("_apart", F.xxhash64(F.lit("cut"), "key")), F.col("_cuts"))).otherwise(F.lit(0)).cast("int")
    parts = written(dealt.join(F.broadcast(per), "_range").withColumn("_part", part), "shard-parts")
    before = W.orderBy("_range", "_part").rowsBetween(W.unboundedPreceding, -1)  # ranges and parts only, as many as the parameters say
    sums = parts.groupBy("_range", "_part").agg(F.sum("size").alias("_bytes"))
    starts = sums.select("_range", "_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_start")).crossJoin(F.broadcast(grand))
    inside = W.partitionBy("_range", "_part").orderBy("key", "_apart", "tie", "_row").rowsBetween(W.unboundedPreceding, -1)
    placed = parts.join(F.broadcast(starts), ["_range", "_part"]).withColumn("_at", F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    group = W.partitionBy("_range", "_part", "key", "_apart")
    # the middle of a group decides, so that a boundary is met to half a group
    middle = F.min("_at").over(group) + F.sum("size").over(group) / 2.0
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.col("_total"))).cast("int"))
    placed = placed.withColumn("_local", F.row_number().over(W.partitionBy("_range", "_part", "shard").orderBy("_at", "tie", "_row")) - 1)
    placed = written(placed, "shard-placed")
    counts = placed.groupBy("shard", "_range", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy("shard").orderBy("_range", "_part").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("shard", "_range", "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_first"))
    out = placed.join(F.broadcast(first), ["shard", "_range", "_part"]).withColumn("slot", (F.col("_first") + F.col("_local")).cast("long"))
    return out.select(*names, "shard", "slot")


def op8_sampled_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_of()
    records = table(spark, sf_dir, "documents").select(
        F.xxhash64(text).alias("key"),
        F.col("doc_id").alias("tie"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shard(records, 8).select(F.col("tie").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
