"""Mixing sources to target weights.

Words are packed into blocks of fixed length, source by source. Each output shard of slots draws its multinomial counts of the
sources: every slot draws a source by the targets' shares, from a seed of shard and slot, and the counts are summed per shard.
The draws are then conditioned on the targets: of a source that was drawn too often, as many slots as there are
too many, chosen by a pseudorandom permutation of its slots, pass to sources that were drawn too rarely. (Draws and choice treat all slots
alike, so, given the totals, every arrangement is equally likely, as in multinomial draws under that condition.)
A source's slots are numbered by prefix sums over the shards, its numbers map through the source's own
permutation to block indices, and blocks are joined by index. So the mix meets its targets to the word, and no block is taken
more often than once for each started pass over its source.

Permutations are swap-or-not shuffles (Hoang, Morris, Rogaway 2012): arithmetic on the index alone, for any size, with
nothing to sort or to keep. Native: DataFrame functions only; the driver sees one row per source.

Defined results: a null text has size 0 and is never taken; sources are ordered by code point with null last; rows with
the same doc_id count as separate documents in an order fixed by their text; an empty table gives no rows; other columns are ignored; texts of any length are counted whole. A row repeated very often is counted once and dealt out by number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import hidden, running_offsets, shown, table, text_of, written
from tessera.llm.sharding import range_of

#: Words in a block, slots in an output shard, rounds of a permutation, documents in a part of a source, slots that a task draws.
BLOCK, SHARD_SLOTS, ROUNDS, PART_ROWS, TASK_SLOTS = 64, 4096, 24, 20_000, 50_000
#: Words in a block where the mix is written as text, so that most documents stay whole.
TEXT_BLOCK = 1024


def n_words(text: Column) -> Column:
    """The number of runs of other characters than space and tab to carriage return."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From source, source_size: adds target. Targets share ``share`` of all sizes by weight and stop at ``most`` times their
    source's size; the excess is shared again: the level at which the rest of the volume is spent (water filling). A
    table of sources, so one window without partitions is in order."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    volume = F.sum("source_size").over(W.partitionBy()) * share
    capped_before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weight_from = F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    levels = w.withColumn("level", (volume - capped_before) / weight_from).withColumn("open", F.col("cap") / F.col("weight") > F.col("level"))
    # the first source that isn't capped sets the level of all later ones
    first = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_level.rowsBetween(W.unboundedPreceding, 0))
    return levels.withColumn("target", F.coalesce(first * F.col("weight"), F.col("cap"))).select("source", "source_size", "target")


def _round(x: Column, n: Column, r: Column, salt: Column) -> Column:
    """One round of swap-or-not on [0, n): x and its partner change places or not."""
    partner = F.pmod(F.pmod(F.xxhash64(F.lit("key"), salt, r, n), n) - x, n)
    coin = F.xxhash64(F.lit("coin"), salt, r, F.greatest(x, partner)).bitwiseAND(F.lit(1))
    return F.when(coin == 1, partner).otherwise(x)


def permuted(x: Column, n: Column, salt: Column, back: bool = False, rounds: int = ROUNDS) -> Column:
    """The place of x under a pseudorandom permutation of [0, n); ``back``: the inverse. n and salt should be plain columns, since each round reads them."""
    steps = F.array(*[F.lit(r) for r in (range(rounds) if not back else reversed(range(rounds)))])
    return F.aggregate(steps, x.cast("long"), lambda acc, r: _round(acc, n, r, salt))


def fragments(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """From row, source, size, at (words of the source before the document): one row per document and block that it reaches into.

    block: index; lo, hi: words of the block that are the document's, hi exclusive; word: of the document, the first of them."""
    last = F.floor((F.col("at") + F.col("size") - 1) / block)
    each = docs.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), last)))
    start = F.col("block") * block
    lo, hi = F.greatest(F.col("at") - start, F.lit(0)), F.least(F.col("at") + F.col("size") - start, F.lit(block))
    return each.select("row", "source", "block", lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), F.greatest(start - F.col("at"), F.lit(0)).alias("word"))


def by_number(values: list[int], k: Column) -> Column:
    """The k-th of few values, one per source."""
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), k + 1)


def draws(spark: SparkSession, wanted: list[int], shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Multinomial counts of the sources per shard: shard, k (number of the source), n. wanted: slots by source, whose shares are the chances."""
    ends, total = [], 0
    for n in wanted:
        total += n
        ends.append(total)
    slot = spark.range(0, total, 1, max(1, -(-total // TASK_SLOTS)))
    shard, place = F.floor(F.col("id") / shard_slots), F.col("id") % shard_slots
    drawn = F.pmod(F.xxhash64(F.lit("draw"), shard, place), F.lit(max(1, total)))
    return slot.select(shard.alias("shard"), range_of(drawn, ends[:-1]).alias("k")).groupBy("shard", "k").agg(F.count(F.lit(1)).alias("n"))


def slots(spark: SparkSession, wanted: list[int], shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per slot of the mix: shard, place (orders a shard's slots), k and i. The numbers i of a source's slots are 0 to its wanted slots, each once."""
    counts = written(draws(spark, wanted, shard_slots), "mix-draws")
    had = [0] * len(wanted)
    for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect():  # one row per source
        had[r["k"]] = r["n"]
    before = running_offsets(counts, ["k"], ["shard"], "n", "before", F.floor(F.col("shard") / PART_ROWS))
    at = lambda values: by_number(values, F.col("k"))
    # few rows that become many: they are spread first
    each = before.repartition(-(-sum(wanted) // TASK_SLOTS) or 1, "shard", "k").withColumn("j", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)))
    each = each.select("shard", "k", F.xxhash64(F.lit("place"), "shard", "k", "j").alias("place"), "j", at(had).alias("had"), at(wanted).alias("wanted"), F.xxhash64(F.lit("keep"), "k").alias("salt"))
    each = each.withColumn("i", F.when(F.col("had") > F.col("wanted"), permuted(F.col("j"), F.col("had"), F.col("salt"))).otherwise(F.col("j")))
    over, starts = 0, []
    for h, n in zip(had, wanted, strict=True):
        starts.append(over)
        over += max(0, h - n)
    if not over:
        return each.select("shard", "place", "k", "i")
    # the over-drawn slots, numbered over all sources, are dealt to the sources that lack some
    lacking = [k for k, (h, n) in enumerate(zip(had, wanted, strict=True)) if h < n]
    ends = [sum(wanted[k] - had[k] for k in lacking[: x + 1]) for x in range(len(lacking))]
    each = each.withColumn("passes", F.col("i") >= F.col("wanted")).withColumn("x", F.when(F.col("passes"), permuted(F.col("i") - F.col("wanted") + at(starts), F.lit(over).cast("long"), F.lit(29).cast("long"))))
    to = range_of(F.col("x"), ends[:-1])
    pick = lambda values: by_number(values, to)
    k = F.when(F.col("passes"), pick(lacking).cast("int")).otherwise(F.col("k"))
    i = F.when(F.col("passes"), F.col("x") - pick([0, *ends[:-1]]) + pick([had[k] for k in lacking])).otherwise(F.col("i"))
    return each.select("shard", "place", k.alias("k"), i.alias("i"))


def dealt(sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """From source, source_size, target (a stored table of few rows): one row per slot of the mix: shard, place, source, block, take (words from the block's start)."""
    s = sources.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("want", F.floor(F.col("target") + 0.5))
    salt = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    s = s.withColumn("salt", F.xxhash64(salt)).withColumn("short", F.col("blocks") * block - F.col("source_size"))
    # where in a pass the short last block comes
    s = s.withColumn("short_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.col("salt"), back=True))
    s = s.withColumn("n", F.floor(F.col("want") / F.col("source_size")) * F.col("blocks") + F.ceil((F.col("want") % F.col("source_size") + F.col("short")) / block)).where("n > 0")
    s = s.withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = written(s, "mix-numbers")
    rows = s.orderBy("k").collect()  # one row per source
    of = lambda name: by_number([r[name] for r in rows], F.col("k"))
    each = slots(sources.sparkSession, [r["n"] for r in rows], shard_slots)
    each = each.withColumn("blocks", of("blocks")).withColumn("salt", of("salt"))
    each = each.withColumn("turn", F.floor(F.col("i") / F.col("blocks"))).withColumn("at", F.col("i") % F.col("blocks"))
    start = F.col("turn") * of("source_size") + F.col("at") * block - F.when(F.col("at") > of("short_at"), of("short")).otherwise(F.lit(0))
    each = each.select("shard", "place", "k", permuted(F.col("at"), F.col("blocks"), F.col("salt")).alias("block"), start.alias("start"))
    length = F.when(F.col("block") == of("blocks") - 1, F.lit(block) - of("short")).otherwise(F.lit(block))
    # stored, because Spark would compute the permutations again for each filter and join on them
    each = written(each.withColumn("take", F.least(length, of("want") - F.col("start")).cast("int")).drop("start"), "mix-slots")
    return each.where("take > 0").join(s.select("k", "source"), "k").select("shard", "place", "source", "block", "take")


def placed(docs: DataFrame) -> DataFrame:
    """From row, source, size: adds at, the words of the same source before the document."""
    parts = F.pmod(F.xxhash64(F.lit("part"), "row"), F.lit(_parts(docs)))
    return running_offsets(docs, ["source"], ["row"], "size", "at", parts)


def _parts(docs: DataFrame) -> int:
    return max(1, -(-docs.count() // PART_ROWS))


def mix(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """From row (unique), source, size. Returns the sources with their targets, and the mix: one row per slot and fragment:
    row, shard, place, lo, hi, word, words (taken from the fragment: its first so many)."""
    sizes = docs.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    sources = written(targets(sizes, weights, share, most), "mix-sources")
    f, s = fragments(placed(docs), block).alias("f"), dealt(sources, block, shard_slots).alias("s")
    same = F.col("f.block").eqNullSafe(F.col("s.block")) & F.col("f.source").eqNullSafe(F.col("s.source")) & (F.col("f.lo") < F.col("s.take"))
    # both sides grow with the words, and the number of generated slots isn't in Spark's estimate: merge, never broadcast
    taken = f.join(s.hint("merge"), same).select("f.row", "f.word", "f.lo", "f.hi", "s.shard", "s.place", (F.least("f.hi", "s.take") - F.col("f.lo")).alias("words"))
    return sources, taken


def numbered(docs: DataFrame, key: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """Stored rows with row: the key columns, which tell all others, and a number that tells rows with the same key apart. Equal rows are counted, and
    made again from the count, parts of ``part_rows`` at a time, so that a row repeated very often is no task of its own."""
    counts = written(docs.groupBy(*docs.columns).agg(F.count(F.lit(1)).alias("_n")), "mix-docs")
    parts = counts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / part_rows))))
    if (counts.agg(F.max("_n").alias("n")).first()["n"] or 0) > part_rows:
        parts = parts.repartition(*key, "_part")
    first = F.col("_part") * part_rows
    each = parts.withColumn("_k", F.explode(F.sequence(first + 1, F.least(first + part_rows, F.col("_n")))))
    return each.withColumn("row", F.struct(*key, F.col("_k").cast("int").alias("n"))).drop("_n", "_part", "_k")


def mixed_documents(docs: DataFrame, block: int = TEXT_BLOCK, **params) -> DataFrame:
    """The mix itself: one row per fragment of a document in a slot of a shard, with the document's columns; its text is the fragment's words with the spaces
    after them, n_chars its length where there is such a column. Whole shards lie together, in the order of shard, place and place
    in the block, so that the texts of a shard, one after the other, are the shard."""
    key = F.struct(F.col("doc_id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("hash"))
    slim = docs.select(key.alias("key"), F.col("source"), n_words(text_of()).alias("size"))
    rows = numbered(slim, ["key"])
    _, taken = mix(rows.select("row", "source", "size"), block, **params)
    # a document's fragments: as many as its own length makes
    per = taken.groupBy("row").agg(F.collect_list(F.struct("shard", "place", "lo", "word", "words")).alias("_frags")).withColumn("_key", F.col("row.key"))
    full = hidden(docs.withColumn("_key", key)).withColumnRenamed("doc___key", "_key")
    if (rows.agg(F.max("row.n").alias("n")).first()["n"] or 1) > 1:  # rows that repeat: each takes its own words from one of them
        full = full.dropDuplicates(["_key"])
    words = F.regexp_extract_all(text_of("doc__text"), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    full = full.join(per, "_key")
    text = lambda w, f: F.array_join(F.slice(w, (f["word"] + 1).cast("int"), f["words"].cast("int")), "")
    cut = lambda w: F.transform("_frags", lambda f: F.struct(f["shard"].alias("shard"), f["place"].alias("place"), f["lo"].alias("lo"), text(w, f).alias("text")))
    # the words are bound as the element of an array of one, so that they are found once per document
    full = full.withColumn("_f", F.explode(F.flatten(F.transform(F.array(words), cut)))).drop("_frags", "doc__text")
    full = full.repartition("_f.shard").sortWithinPartitions("_f.shard", "_f.place", "_f.lo")
    return shown(full, docs, text=F.col("_f.text"), n_chars=F.length("_f.text"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(text_of()).alias("size"), F.xxhash64("text").alias("text"))
    rows = numbered(slim, ["doc_id", "text", "source"])
    sources, taken = mix(rows.select("row", "source", "size"))
    per = taken.groupBy("row").agg(F.sum("words").cast("long").alias("taken"))
    out = rows.join(per, "row", "left").alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    return out.select("d.doc_id", "d.size", "s.source_size", "s.target", F.coalesce("d.taken", F.lit(0)).cast("long").alias("taken"))
