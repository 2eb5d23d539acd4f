"""Splits and merges in a frame whose regions came from the frame before: those regions (``came``: t, spix) keep their ids, and their priors' counts follow.

Priors are rows t, spix, prior_count, p_xx, p_xy, p_yy (see regions.map_update). Everything is per region after one aggregate over pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.segment import evidence, grown, half_sums, merge_scores, move_all, neighbour_pairs, smoothed_parameters, steered


def propagated_regions(p: DataFrame) -> DataFrame:
    """t, spix of the regions whose label the frame before has too."""
    have = p.where("spix >= 0").select("t", "spix").distinct()
    return have.join(have.select((F.col("t") + 1).alias("t"), "spix"), ["t", "spix"], "left_semi")


def split_scores(h: DataFrame, came: DataFrame, sigma2: float, split_alpha: float = 0.0) -> DataFrame:
    """From pixels with half and gone (no label came to the pixel): t, spix, came, kept, swapped, score, accepted.

    kept: the half that keeps the id, in a region that came along the one with fewer gone pixels (ties: the first), else the first. swapped: the second half has fewer.
    The score of a region that came along is less by twice the share of the kept half's pixels that aren't gone."""
    gone = [F.count_if((F.col("half") == k) & F.col("gone")).alias(f"{n}_gone") for k, n in enumerate("ks")]
    g = half_sums(h, *gone).join(came.select("t", "spix", F.lit(True).alias("came")), ["t", "spix"], "left").withColumns({"came": F.coalesce("came", F.lit(False)), "swapped": F.col("k_gone") > F.col("s_gone")})
    share = F.when(~F.col("came"), 1.0).when(F.col("swapped"), F.col("s_gone") / F.col("s_n")).otherwise(F.col("k_gone") / F.col("k_n"))
    score = evidence("k_", sigma2) + evidence("s_", sigma2) - evidence("f_", sigma2) + split_alpha - (1.0 - share) * 2
    kept = F.when(F.col("came") & F.col("swapped"), 1).otherwise(0)
    return g.select("t", "spix", "came", kept.alias("kept"), "swapped", score.alias("score")).withColumn("accepted", F.col("score") > -2)


def new_ids(p: DataFrame, scored: DataFrame) -> DataFrame:
    """Accepted splits with new_spix, numbers after the frame's largest label in the order of labels (a frame has a bounded number of them)."""
    top = p.groupBy("t").agg(F.max("spix").alias("_top"))
    n = F.row_number().over(W.partitionBy("t").orderBy("spix"))
    return scored.where("accepted").withColumn("_n", n).join(top, "t").withColumn("new_spix", (F.col("_top") + F.col("_n")).cast("int")).drop("_top", "_n")


def divided(h: DataFrame, splits: DataFrame) -> DataFrame:
    """Applies splits (t, spix, kept, new_spix) to pixels with half, which goes."""
    j = h.join(splits.select("t", "spix", "kept", "new_spix"), ["t", "spix"], "left")
    return j.withColumn("spix", F.when(F.col("new_spix").isNotNull() & (F.col("half") != F.col("kept")), F.col("new_spix")).otherwise(F.col("spix")).cast("int")).drop("half", "kept", "new_spix")


def split_priors(priors: DataFrame, splits: DataFrame, least: float = 36.0) -> DataFrame:
    """Priors after splits (t, spix, swapped, new_spix). The id that stays keeps its prior and the new one gets half its count; where the halves were swapped both get half, ``least`` or more,
    and a round shape. A new id's shape is round too: of a prior's covariance only the proportions count."""
    j = priors.join(splits.select("t", "spix", "swapped", "new_spix"), ["t", "spix"], "left")
    half = F.when(F.col("swapped"), F.greatest(F.col("prior_count") / 2, F.lit(least))).otherwise(F.col("prior_count") / 2)
    turned = F.coalesce("swapped", F.lit(False))
    round_ = {"p_xx": 1.0, "p_xy": 0.0, "p_yy": 1.0}
    stays = j.select("t", "spix", F.when(turned, half).otherwise(F.col("prior_count")).alias("prior_count"), *[F.when(turned, v).otherwise(F.col(c)).alias(c) for c, v in round_.items()])
    fresh = j.where("new_spix is not null").select("t", F.col("new_spix").alias("spix"), half.alias("prior_count"), *[F.lit(v).alias(c) for c, v in round_.items()])
    return stays.unionByName(fresh)


def mixed_pairs(pairs: DataFrame, came: DataFrame) -> DataFrame:
    """Pairs (t, f, k) of which exactly one region came along, with f_came."""
    side = lambda name: came.select("t", F.col("spix").alias(name), F.lit(True).alias(f"_{name}"))
    j = pairs.join(side("f"), ["t", "f"], "left").join(side("k"), ["t", "k"], "left").withColumns({"f_came": F.coalesce("_f", F.lit(False)), "_k": F.coalesce("_k", F.lit(False))})
    return j.where(F.col("f_came") != F.col("_k")).drop("_f", "_k")


def claims(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    """t, f, k: f goes, k stays and is the one that came along. From merge scores of mixed pairs: of accepted claims on one target the best wins (ties: smaller id). A claim holds if its
    target has won no claim of its own, or if both want each other (then once). Whoever claimed, the region that came along stays; no region that stays goes elsewhere, and none goes twice."""
    won = scored.where("accepted").groupBy("t", "k").agg(F.max_by("f", F.struct("score", -F.col("f"))).alias("f"))
    won = won.join(pairs.select("t", "f", "k", "f_came"), ["t", "f", "k"])
    target = won.select("t", F.col("f").alias("k"), F.col("k").alias("_to"))
    holds = won.join(target, ["t", "k"], "left").where((F.col("_to").isNull()) | ((F.col("_to") == F.col("f")) & F.col("f_came")))
    return holds.select("t", F.when(F.col("f_came"), F.col("k")).otherwise(F.col("f")).alias("f"), F.when(F.col("f_came"), F.col("f")).otherwise(F.col("k")).alias("k"))


def merged(p: DataFrame, won: DataFrame) -> DataFrame:
    """Pixels of f become k."""
    return p.join(won.select("t", F.col("f").alias("spix"), F.col("k").alias("_to")), ["t", "spix"], "left").withColumn("spix", F.coalesce("_to", "spix").cast("int")).drop("_to")


def merged_priors(priors: DataFrame, won: DataFrame) -> DataFrame:
    """Counts of the regions that go are added to those of the regions that stay; shapes stay."""
    j = priors.join(won.select("t", F.col("f").alias("spix"), F.col("k").alias("_to")), ["t", "spix"], "left")
    more = j.where("_to is not null").groupBy("t", F.col("_to").alias("spix")).agg(F.sum("prior_count").alias("_more"))
    stay = j.where("_to is null").drop("_to").join(more, ["t", "spix"], "left")
    return stay.withColumn("prior_count", F.col("prior_count") + F.coalesce("_more", F.lit(0.0))).drop("_more")


def refined(p: DataFrame, came: DataFrame, priors: DataFrame, target: float, rounds: int, sigma2: float = 400.0, beta: float = 0.5, log_alpha: float = 2.0, slack: float = 0.05, step: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """The main loop (segment.refined) for frames that were propagated: t, y, x, c0, c1, c2, spix, gone. Splits and merges keep the regions that came along, priors follow them and shape
    the label moves. Returns pixels and priors. Frames inside the band of the wanted number of regions have no bonus, and the loop ends when all are, or after ``rounds``."""
    from tessera.operators.lineage import cut
    from tessera.operators.regions import moments

    p, priors, bonus = cut(p.select("t", "y", "x", "c0", "c1", "c2", "spix", "gone")), cut(priors), None
    for k in range(rounds):
        m = cut(moments(p, squares=True))
        have = m.groupBy("t").agg(F.count(F.lit(1)).alias("have"))
        bonus = cut(steered(have, have.select("t", F.lit(0.0).alias("bonus")) if bonus is None else bonus, target, slack, step))
        if bonus.where("not inside").isEmpty():
            break
        axis, open_ = "xy"[k // 2 % 2], bonus.where("not inside").select("t", "bonus")
        if k % 2:
            pairs = cut(mixed_pairs(neighbour_pairs(p, axis), came).join(open_, "t"))
            won = cut(claims(merge_scores(m, pairs, sigma2, log_alpha, -F.col("bonus")), pairs))
            p, priors = cut(merged(p, won)), cut(merged_priors(priors, won))
        else:
            h = grown(p, axis)
            scored = split_scores(h, came, sigma2).join(open_, "t").withColumn("accepted", F.col("score") + F.col("bonus") > -2)
            splits = cut(new_ids(p, scored))
            p, priors = cut(divided(h, splits).select(*p.columns)), cut(split_priors(priors, splits))
        p = move_all(p, cut(smoothed_parameters(cut(moments(p)), priors)), sigma2, beta)
    return p, priors
