"""One step each of region refinement: label moves, split and merge scores, replacement of dead labels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.neighbours import EIGHT, along_column, along_row, eight, simple_points

SIDES = ("n", "s", "w", "e")


def move_labels(p: DataFrame, regions: DataFrame, parity: tuple[int, int], sigma2: float, beta: float) -> DataFrame:
    """One parity (x % 2, y % 2) of a Potts step. A border pixel takes, among its side neighbours' labels, the one of highest score under its region (mean colour,
    position, inverse covariance) with a penalty per differing neighbour, if it is simple for each of these labels: taking it neither closes
    nor joins parts of any of them around the pixel. Ties go by the order n, s, w, e, at six digits, so that the order of sums doesn't matter. A pixel of a region of at most
    two pixels that would stay goes to the first of n, e, s, w. Off the raster, and missing labels, count as equal to any.

    regions: t, spix, n, mu_c0.., mu_x, mu_y, i_xx, i_xy, i_yy, logdet."""
    q = eight(p.repartition("t"), "spix")  # a frame's windows along rows and columns after one exchange
    off = F.lit(False)
    for k in SIDES:
        off = off | F.col(k).isNull() | (F.col(k) != F.col("spix"))
    q = q.where(off & (F.col("spix") >= 0) & (F.col("x") % 2 == parity[0]) & (F.col("y") % 2 == parity[1]))
    q = q.withColumns({k: F.coalesce(F.col(k), F.lit(-1)) for k in EIGHT})
    first = F.coalesce(*[F.when(F.col(k) >= 0, F.col(k)) for k in ("n", "e", "s", "w")])
    q = q.select("t", "y", "x", "c0", "c1", "c2", F.col("spix").alias("_own"), first.alias("_first"), *EIGHT, F.posexplode(F.array(*SIDES)).alias("k", "c"))
    # bit i: neighbour i of EIGHT holds the label, or none
    bits = sum((F.when((F.col(k) == F.col("c")) | (F.col(k) == -1), 1 << i).otherwise(0) for i, k in enumerate(EIGHT)), F.lit(0))
    q = q.withColumn("_bits", bits).drop(*EIGHT)
    free = F.element_at(F.array(*[F.lit(v) for v in simple_points()]), F.col("_bits") + 1)
    j = q.withColumn("_free", free).join(regions.withColumnRenamed("spix", "c"), ["t", "c"], "left")
    score = F.round(likelihood(sigma2) - (8 - F.bit_count("_bits")) * beta, 6)
    best = F.max(F.when(F.col("c") >= 0, F.struct(score.alias("s"), (-F.col("k")).alias("k"), "c")))
    j = j.groupBy("t", "y", "x").agg(F.bool_and("_free").alias("_free"), best.alias("_b"), F.first("_own").alias("_own"), F.first("_first").alias("_first")).where("_free and _b is not null")
    tiny = regions.where("n <= 2").select("t", F.col("spix").alias("_own"), F.lit(True).alias("_tiny"))
    best = F.when(F.col("_b.s") > -9999, F.col("_b.c")).otherwise(F.col("_own"))
    new = F.when(F.col("_tiny") & (best == F.col("_own")), F.col("_first")).otherwise(best)
    j = j.join(tiny, ["t", "_own"], "left").select("t", "y", "x", new.alias("_new"))
    return p.join(j, ["t", "y", "x"], "left").withColumn("spix", F.coalesce("_new", "spix")).drop("_new")


def likelihood(sigma2: float) -> Column:
    """Log-likelihood of a pixel under a joined region, up to a constant; offsets are truncated to whole pixels, small regions are penalised."""
    colour = sum((F.pow(F.col(f"c{k}") - F.col(f"mu_c{k}"), 2) for k in range(3)), F.lit(0.0)) / sigma2
    whole = lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double")
    dx, dy = whole(F.col("x") - F.col("mu_x")), whole(F.col("y") - F.col("mu_y"))
    shape = dx * dx * F.col("i_xx") + dy * dy * F.col("i_yy") + dx * dy * F.col("i_xy") * 2.0
    return -colour - shape - F.col("logdet") - F.when(F.col("n") <= 10, 100.0).otherwise(0.0) - 1000.0


def move_all(p: DataFrame, regions: DataFrame, sigma2: float, beta: float) -> DataFrame:
    """The four parities, each on what the one before has left."""
    from tessera.operators.lineage import cut, dropped

    regions, made = cut(regions), []
    for parity in ((0, 0), (0, 1), (1, 0), (1, 1)):
        p = cut(move_labels(p, regions, parity, sigma2, beta))
        dropped(*made)
        made = [p]
    dropped(regions)
    return p


def marginal(n: Column, s: Column, q: Column, sigma2: float, a0: float = 1e4) -> Column:
    """Log marginal of n values with sum s and sum of squares q under a normal-inverse-gamma prior; the gamma terms cancel."""
    b0 = 2 * math.sqrt(sigma2) * a0
    b = F.lit(b0) + (q - s * s / n) * 0.5
    a = n * 0.5 + a0
    return a * math.log(b0) - F.ln(n) * 0.5 - a * F.ln(b) - n * (0.5 * math.log(math.pi) + math.log(2))


def evidence(prefix: str, sigma2: float) -> Column:
    """Sum of the channels' marginals, from columns <prefix>n, <prefix>s_c0.., <prefix>q_c0.. ."""
    n = F.col(f"{prefix}n").cast("double")
    return sum((marginal(n, F.col(f"{prefix}s_c{k}").cast("double"), F.col(f"{prefix}q_c{k}").cast("double"), sigma2) for k in range(3)), F.lit(0.0))


def neighbour_pairs(p: DataFrame, axis: str = "x") -> DataFrame:
    """t, f, k: each region and the largest label to its right (axis y: below it) that differs."""
    q = p.select("t", "y", "x", "spix", F.lead("spix").over(along_row() if axis == "x" else along_column()).alias("e"))
    return q.where("spix >= 0 and e >= 0 and e != spix").groupBy("t", F.col("spix").alias("f")).agg(F.max("e").alias("k"))


SUMS = ["n", *[f"{a}_c{k}" for a in "sq" for k in range(3)]]


def merge_scores(moments: DataFrame, pairs: DataFrame, sigma2: float, log_alpha: float, bonus: Column | float = 0.0) -> DataFrame:
    """t, f, k, score, accepted: evidence of the union less that of its parts, from the parts' sums (no pixel is read again). bonus may be a column of the pairs."""
    side = lambda name: moments.select("t", F.col("spix").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in SUMS])
    j = pairs.join(side("f"), ["t", "f"]).join(side("k"), ["t", "k"])
    j = j.withColumns({f"u_{c}": F.col(f"f_{c}") + F.col(f"k_{c}") for c in SUMS})
    score = evidence("u_", sigma2) - log_alpha - evidence("f_", sigma2) - evidence("k_", sigma2) + (bonus if isinstance(bonus, Column) else F.lit(bonus))
    return j.select("t", "f", "k", score.alias("score")).withColumn("accepted", F.col("score") > -2)


def claims(scored: DataFrame) -> DataFrame:
    """Of accepted merges that want the same target, the best stays (ties: smaller id); of two that want each other, the smaller id's goes."""
    won = scored.where("accepted").groupBy("t", "k").agg(F.max_by("f", F.struct("score", -F.col("f"))).alias("f"))
    back = won.select("t", F.col("f").alias("k"), F.col("k").alias("f"), F.lit(True).alias("_back"))
    return won.join(back, ["t", "f", "k"], "left").where("_back is null or f > k").select("t", "f", "k")


def adjacent(p: DataFrame) -> DataFrame:
    """t, f, k with f < k: all pairs of regions that touch along a row or a column."""
    q = p.select("t", "spix", F.lead("spix").over(along_row()).alias("e"), F.lead("spix").over(along_column()).alias("s"))
    each = q.select("t", "spix", F.explode(F.array("e", "s")).alias("o")).where("spix >= 0 and o >= 0 and o != spix")
    return each.select("t", F.least("spix", "o").alias("f"), F.greatest("spix", "o").alias("k")).distinct()


def _swept(q: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Distances inside regions after a sweep along the rows and one along the columns: in a run of one label a pixel is as far as any other of the run and the way between."""
    for line, run, at in (("y", "_run_x", "x"), ("x", "_run_y", "y")):
        w = W.partitionBy("t", line, run).orderBy(at)
        before, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
        q = q.withColumns({n: F.least(F.min(F.col(n) - F.col(at)).over(before) + F.col(at), F.min(F.col(n) + F.col(at)).over(after) - F.col(at)) for n in names})
    return q


def grown(p: DataFrame, axis: str = "x") -> DataFrame:
    """Splits each region by growth from two seeds beside its mean (a pixel left and right of it; axis y: two above and below): adds half, 1 where
    the second seed is nearer by steps inside the region, else 0; null where no seed is reached or the label is missing. A seed outside its region is dropped.

    Sweeps repeat until nothing changes; their number follows the turns of the longest way, not its length. Rows are dealt out by frame, so the windows along rows, columns and
    runs of a round share one exchange."""
    from tessera.operators.lineage import cut, dropped, owning

    starts = lambda w, at: F.last(F.when((F.lag("spix").over(w) == F.col("spix")) & (F.lag(at).over(w) == F.col(at) - 1), F.lit(None)).otherwise(F.col(at)), ignorenulls=True).over(w)
    mean = p.where("spix >= 0").groupBy("t", "spix").agg(F.avg("y").cast("int").alias("_my"), F.avg("x").cast("int").alias("_mx"))
    q = p.join(mean, ["t", "spix"], "left").repartition("t").withColumn("_run_x", starts(along_row(), "x")).withColumn("_run_y", starts(along_column(), "y"))
    dy, dx = (0, 1) if axis == "x" else (2, 0)
    seed = lambda sign: F.when((F.col("y") == F.col("_my") + sign * dy) & (F.col("x") == F.col("_mx") + sign * dx), F.lit(0))
    q = cut(q.withColumns({"_d1": seed(-1), "_d2": seed(1)}).drop("_my", "_mx"))
    while True:
        old, names = q, ("_d1", "_d2")
        near = _swept(old.select(*p.columns, "_run_x", "_run_y", *names).repartition("t"), names).withColumns({"_o1": F.col("_d1"), "_o2": F.col("_d2")})
        moved = ~F.col("_d1").eqNullSafe(F.col("_o1")) | ~F.col("_d2").eqNullSafe(F.col("_o2"))
        q = cut(_swept(near, names).withColumn("_moved", moved).drop("_o1", "_o2"))
        dropped(old)
        if q.where("_moved").isEmpty():
            break
    nearer = F.when(F.col("_d1").isNull() & F.col("_d2").isNull(), F.lit(None)).otherwise(F.coalesce(F.col("_d1") > F.col("_d2"), F.col("_d1").isNull()).cast("int"))
    return owning(q.select(*p.columns, nearer.alias("half")), q)


def merged(p: DataFrame, won: DataFrame) -> DataFrame:
    """Applies claims (t, f, k): pixels of f become k. A target that itself merges away takes none in this step."""
    free = won.join(won.select("t", F.col("f").alias("k")), ["t", "k"], "left_anti")
    return p.join(free.select("t", F.col("f").alias("spix"), F.col("k").alias("_to")), ["t", "spix"], "left").withColumn("spix", F.coalesce("_to", "spix")).drop("_to")


def divided(h: DataFrame, accepted: DataFrame) -> DataFrame:
    """Applies splits (t, spix) to pixels with half: the second half gets a number after the frame's largest label, by region."""
    top = h.groupBy("t").agg(F.max("spix").alias("_top"))
    new = accepted.withColumn("_n", F.row_number().over(W.partitionBy("t").orderBy("spix"))).join(top, "t").select("t", "spix", (F.col("_top") + F.col("_n")).alias("_new"))
    return h.join(new, ["t", "spix"], "left").withColumn("spix", F.when((F.col("half") == 1) & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("spix")).cast("int")).drop("half", "_new")


def parameters(p: DataFrame) -> DataFrame:
    """What move_labels needs of each region."""
    from tessera.operators.regions import moments

    return parameters_of(moments(p))


def parameters_of(m: DataFrame) -> DataFrame:
    """The same from moments."""
    from tessera.functions import geometry
    from tessera.operators.regions import summary

    c = [F.col(k) for k in ("xx", "xy", "yy")]
    return summary(m).select("t", "spix", "n", *[f"mu_{k}" for k in ("c0", "c1", "c2", "x", "y")], *[v.alias(k) for v, k in zip(geometry.inverse(*c), ("i_xx", "i_xy", "i_yy"), strict=True)], geometry.log_det(*c).alias("logdet"))


def refined_with(p: DataFrame, prior: DataFrame, rounds: int, sigma2: float, beta: float) -> DataFrame:
    """Rounds of parameters and label moves, with a prior of the regions' covariances (t, spix, prior_count, p_xx, p_xy, p_yy); regions without one are as their pixels say."""
    from tessera.operators.lineage import dropped
    from tessera.operators.regions import moments

    made = []
    for _ in range(rounds):
        p = move_all(p, smoothed_parameters(moments(p), prior), sigma2, beta)
        dropped(*made)
        made = [p]
    return p


def smoothed_parameters(m: DataFrame, prior: DataFrame) -> DataFrame:
    """What move_labels needs of each region, from moments, with a prior's covariance where a region has one."""
    from tessera.operators.regions import map_update

    shape = ["i_xx", "i_xy", "i_yy", "logdet"]
    smooth = map_update(m, prior).select("t", "spix", *[F.col(c).alias(f"_{c}") for c in shape])
    own = parameters_of(m).join(smooth, ["t", "spix"], "left")
    return own.select("t", "spix", "n", *[f"mu_{k}" for k in ("c0", "c1", "c2", "x", "y")], *[F.coalesce(f"_{c}", c).alias(c) for c in shape])


def priors_of(p: DataFrame) -> DataFrame:
    from tessera.operators.regions import moments, summary

    return summary(moments(p)).select("t", "spix", F.col("n").cast("double").alias("prior_count"), *[F.col(c).alias(f"p_{c}") for c in ("xx", "xy", "yy")])


def forward_backward(p: DataFrame, rounds: int, inner: int = 1, sigma2: float = 400.0, beta: float = 0.5) -> DataFrame:
    """Refinement of all frames of t, y, x, c0, c1, c2, spix with the next frame's covariances as priors, cyclic in time. Frames but the last need what the frame after them
    was before the round, so they go together; the last one needs what the first has become."""
    from tessera.operators.lineage import cut, dropped

    p = cut(p.select("t", "y", "x", "c0", "c1", "c2", "spix"))
    first, last = p.agg(F.min("t"), F.max("t")).first()
    for _ in range(rounds):
        after = cut(priors_of(p).withColumn("t", F.col("t") - 1))
        most = refined_with(p.where(F.col("t") != last), after, inner, sigma2, beta)
        begin = most if first != last else p
        turn = cut(priors_of(begin.where(F.col("t") == first)).withColumn("t", F.lit(last).cast("int")))
        end = refined_with(p.where(F.col("t") == last), turn, inner, sigma2, beta)
        old, p = p, cut(most.unionByName(end))
        # without inner rounds the frames are those of the old table
        dropped(old, after, turn, *((most, end) if inner else ()))
    return p


def steered(have: DataFrame, before: DataFrame, target: float, slack: float, step: float) -> DataFrame:
    """From t, have (regions) and t, bonus of the round before: t, bonus, inside. A frame above the band makes splits harder and merges easier by ``step``
    with each round, one below it the other way round; it starts from nothing when it crosses the band, and has no bonus in it."""
    over, under = F.col("have") > target * (1 + slack), F.col("have") < target * (1 - slack)
    old = F.coalesce(F.col("bonus"), F.lit(0.0))
    bonus = F.when(over, F.least(old, F.lit(0.0)) - step).when(under, F.greatest(old, F.lit(0.0)) + step).otherwise(0.0)
    return have.join(before, "t", "left").select("t", bonus.alias("bonus"), (~over & ~under).alias("inside"))


def refined(p: DataFrame, target: float, rounds: int, sigma2: float = 400.0, beta: float = 0.5, log_alpha: float = 2.0, slack: float = 0.05, step: float = 2.0, least: int = 0) -> DataFrame:
    """The main loop on t, y, x, c0, c1, c2, spix (no label missing). Each round counts every frame's regions and sets its bonus (see steered), splits or
    merges along one axis (splits and merges take turns, and after both the axis changes), and moves labels over the four parities. A frame inside the
    band after ``least`` rounds stops; the loop ends when all have, or after ``rounds``. Stopped frames are kept apart, so a round works on open ones only."""
    from tessera.operators.lineage import cut, dropped
    from tessera.operators.regions import moments

    p, closed, bonus = cut(p.select("t", "y", "x", "c0", "c1", "c2", "spix")), [], None
    for k in range(rounds):
        m = cut(moments(p, squares=True))
        have = m.groupBy("t").agg(F.count(F.lit(1)).alias("have"))
        bonus = cut(steered(have, have.select("t", F.lit(0.0).alias("bonus")) if bonus is None else bonus, target, slack, step))
        if k >= least:
            inside = bonus.where("inside").select("t")
            if not inside.isEmpty():
                closed.append(cut(p.join(inside, "t", "left_semi")))
                old, p, m = p, cut(p.join(inside, "t", "left_anti")), m.join(inside, "t", "left_anti")
                dropped(old)
            if bonus.where("not inside").isEmpty():
                break
        begun = [p]
        axis = "xy"[k // 2 % 2]
        if k % 2:
            won = claims(merge_scores(m, neighbour_pairs(p, axis).join(bonus, "t"), sigma2, log_alpha, -F.col("bonus")))
            p = cut(merged(p, won))
        else:
            h = grown(p, axis)
            begun.append(h)
            good = split_scores(h, sigma2).join(bonus, "t").where("score + bonus > -2").select("t", "spix")
            p = cut(divided(h, good).select(*p.columns))
        dropped(*begun)
        begun, p = p, move_all(p, parameters(p), sigma2, beta)
        dropped(begun)
    else:
        closed.append(p)
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return out


def half_sums(h: DataFrame, *more: Column) -> DataFrame:
    """From pixels with half: t, spix and the sums that evidence() takes, of the region (f_), its first half (k_) and its second (s_); regions with an empty half, or with pixels in neither, aren't there."""
    sums = {"n": F.lit(1)} | {f"s_c{k}": F.col(f"c{k}") for k in range(3)} | {f"q_c{k}": F.col(f"c{k}") * F.col(f"c{k}") for k in range(3)}
    agg = []
    for name, cond in (("f", F.lit(True)), ("k", F.col("half") == 0), ("s", F.col("half") == 1)):
        agg += [F.sum(F.when(cond, v).otherwise(0)).cast("long").alias(f"{name}_{c}") for c, v in sums.items()]
    return h.groupBy("t", "spix").agg(*agg, *more).where("k_n >= 1 and s_n >= 1 and k_n + s_n = f_n")


def split_scores(h: DataFrame, sigma2: float, split_alpha: float = 0.0) -> DataFrame:
    """From pixels with half: t, spix, score, accepted. Regions that come from another frame have a rule of their own (operators/propagated.py)."""
    score = evidence("k_", sigma2) + evidence("s_", sigma2) - evidence("f_", sigma2) + split_alpha
    return half_sums(h).select("t", "spix", score.alias("score")).withColumn("accepted", F.col("score") > -2)


#: Blocks of transport: cells across, cells that targets may lie beside one, frames of a group, rows of a group about, pairs compared at once.
ACROSS, BESIDE, TIMES, GROUP_ROWS, PAIRS = 16, 8, 16, 20_000, 2_000_000


def _nearest(b: pd.DataFrame, best: int, alpha: float, unit: float, reach: tuple[int, int], side: float) -> Iterator[tuple]:
    """Of the rows of one region's block over some frames, frame by frame: rows that look, whether their result is certain, and for each the best rows of the frame before (-1: fewer) and costs."""
    from tessera.operators.search import COST_DIGITS

    t, q, colours = b["t"].to_numpy(), b["r"].to_numpy(), b[["c0", "c1", "c2"]].to_numpy(float)
    u, v = ((b[c].to_numpy() - b[f"m{c}"].to_numpy()) / unit for c in "xy")
    order = np.lexsort((q, t))
    frames, begin = np.unique(t[order], return_index=True)
    rows = dict(zip(frames.tolist(), np.split(order, begin[1:]), strict=True))
    asks = b["asks"].to_numpy()
    low = [(k - 0.5) * ACROSS * side - BESIDE * side for k in reach]
    high = [(k + 0.5) * ACROSS * side + BESIDE * side for k in reach]
    wall = np.minimum(np.minimum(u - low[0], high[0] - u), np.minimum(v - low[1], high[1] - v))
    whole = (b["pu0"].to_numpy() >= low[0]) & (b["pu1"].to_numpy() < high[0]) & (b["pv0"].to_numpy() >= low[1]) & (b["pv1"].to_numpy() < high[1])
    for k, mine in rows.items():
        mine, there = mine[asks[mine]], rows.get(k - 1, np.empty(0, np.int64))
        step = max(1, PAIRS // max(1, len(there)))
        for a in (mine[i : i + step] for i in range(0, len(mine), step)):
            place = np.sqrt((u[a, None] - u[there]) ** 2 + (v[a, None] - v[there]) ** 2)
            colour = np.sqrt(sum((colours[a, None, c] - colours[there, c]) ** 2 for c in range(3)))
            cost = np.rint((place * alpha + colour * (1 - alpha)) * 10.0**COST_DIGITS) / 10.0**COST_DIGITS
            n = min(best, len(there))
            # ties go by q, the order of targets
            some = np.argsort(cost, axis=1, kind="stable")[:, :n]
            least = np.take_along_axis(cost, some, axis=1)
            found = np.full((len(a), best), -1, np.int64)
            found[:, :n] = there[some]
            sure = whole[a] | ((n == best) & (least[:, -1] < wall[a] * alpha - 10.0**-COST_DIGITS) if n else False)
            yield a, sure, found, np.pad(least, ((0, 0), (0, best - n)), constant_values=np.inf)


def _transported(p: DataFrame, best: int, alpha: float, sharp: float, unit: float, side: float, value: str) -> DataFrame:
    """t, spix, r, y, x, q, w, warped: for each pixel (rank r in its region) the ``best`` pixels q of the same region in the frame before, by the cost
    alpha x distance of places + (1 - alpha) x distance of colours, ties by rank, with weights w, softmax(sharp x exp(-cost)); warped: their values so weighted.

    Places are relative to the region's mean place in its frame, in units of ``unit`` pixels. A region is cut in blocks of cells of ``side`` units, and a block is compared, as arrays, with the
    pixels of the frame before that lie in it or near it; blocks are dealt to groups of bounded size. Pixels that may have better ones further away go on to ring_search, so results are
    those of comparing all pixels of a region with all."""
    from tessera.operators.lineage import cut, dropped
    from tessera.operators.regions import rank_in_region
    from tessera.operators.search import gap, ring_search

    colours, made = ("c0", "c1", "c2"), []
    p = p.where("spix >= 0").select("t", "y", "x", *colours, "spix")
    ranks = rank_in_region(p, made).withColumnRenamed("rank", "r")
    box = p.groupBy("t", "spix").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), *[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    at = lambda c, place: (F.col(f"{place}{c}") - F.col(f"m{c}")) / unit
    box = cut(box.select("t", "spix", "mx", "my", *[at(c, f"{n}_").alias(f"{n}{w}") for c, w in (("x", "u"), ("y", "v")) for n in ("lo", "hi")]))
    wide, far = ACROSS * side, BESIDE * side
    cell = lambda c: F.floor(c / wide + 0.5)
    past = box.select((F.col("t") + 1).alias("t"), "spix", *[F.col(f"{n}{w}").alias(f"p{w}{k}") for w in "uv" for k, n in enumerate(("lo", "hi"))])
    later = box.select((F.col("t") - 1).alias("t"), "spix", *[cell(F.col(f"{n}{w}")).alias(f"n{w}{k}") for w in "uv" for k, n in enumerate(("lo", "hi"))])
    per = cut(box.select("t", "spix", "mx", "my").join(past, ["t", "spix"], "left").join(later, ["t", "spix"], "left"))
    rows = ranks.join(per, ["t", "spix"]).withColumns({"u": at("x", ""), "v": at("y", ""), "asks": F.col("pu0").isNotNull()})
    ends = lambda w: F.sequence(F.greatest(cell(F.col(w) - far), F.col(f"n{w}0")), F.least(cell(F.col(w) + far), F.col(f"n{w}1")))
    meets = lambda w: F.greatest(cell(F.col(w) - far), F.col(f"n{w}0")) <= F.least(cell(F.col(w) + far), F.col(f"n{w}1"))
    spot = lambda i, j, t: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.floor(t / TIMES).cast("long").alias("k"))
    none = F.expr("cast(array() as array<struct<i:bigint,j:bigint,k:bigint>>)")
    own = F.when(F.col("asks"), F.array(spot(cell(F.col("u")), cell(F.col("v")), F.col("t")))).otherwise(none)
    seen = F.when(meets("u") & meets("v"), F.flatten(F.transform(ends("u"), lambda i: F.transform(ends("v"), lambda j: spot(i, j, F.col("t") + 1))))).otherwise(none)
    groups = max(1, -(-p.count() // GROUP_ROWS))
    rows = rows.withColumn("_b", F.explode(F.array_union(own, seen))).select("t", "spix", "r", "y", "x", *colours, "mx", "my", "pu0", "pu1", "pv0", "pv1", "asks", "_b.*")
    rows = rows.withColumn("_g", F.pmod(F.xxhash64("spix", "i", "j", "k"), F.lit(groups)))

    def compared(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, own_t = [], pdf["t"].to_numpy() // TIMES
        width = ACROSS * side
        mine = [np.floor((pdf[c].to_numpy() - pdf[f"m{c}"].to_numpy()) / unit / width + 0.5) for c in "xy"]
        # a row asks in its own block only, and is there to be found in the others
        pdf["asks"] &= (own_t == pdf["k"]) & (mine[0] == pdf["i"]) & (mine[1] == pdf["j"])
        for (_s, i, j, _k), b in pdf.groupby(["spix", "i", "j", "k"], sort=False):
            r, from_ = b["r"].to_numpy(), b[value].to_numpy(float)
            for a, sure, found, cost in _nearest(b, best, alpha, unit, (i, j), side):
                there = found >= 0
                e = np.where(there, np.exp(np.exp(-cost) * sharp), 0.0)
                w = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-300)
                few = b.iloc[a][["t", "spix", "r", "y", "x"]].assign(sure=sure, warped=(w * from_[found]).sum(axis=1))
                few["q"] = [x[y].tolist() for x, y in zip(r[found], there, strict=True)]
                few["w"] = [x[y].tolist() for x, y in zip(w, there, strict=True)]
                out.append(few)
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("t", "spix", "r", "y", "x", "sure", "warped", "q", "w")})

    kinds = "t int, spix int, r long, y int, x int, sure boolean, warped double, q array<bigint>, w array<double>"
    done = cut(rows.groupBy("_g").applyInPandas(compared, kinds))
    dropped(*made)
    columns = ["t", "spix", "r", "y", "x", "q", "w", "warped"]
    out, open_ = done.where("sure").select(*columns), done.where("not sure").select("t", "spix", "r", "y", "x")
    if not open_.isEmpty():
        made = []
        keys = open_.select("t", "spix").distinct()
        both = keys.union(keys.select((F.col("t") - 1).alias("t"), "spix")).distinct()
        mean = per.select("t", "spix", "mx", "my")
        a = cut(rank_in_region(p.join(both, ["t", "spix"], "left_semi"), made).withColumnRenamed("rank", "r").join(mean, ["t", "spix"]).select("t", "spix", "r", *colours, at("x", "").alias("u"), at("y", "").alias("v")))
        before = a.select((F.col("t") + 1).alias("t"), "spix", F.col("r").alias("q"), "u", "v", *colours)
        found = ring_search(a.join(open_.select("t", "spix", "r"), ["t", "spix", "r"], "left_semi"), before, ["t", "spix"], best, side, lambda x: gap(x, ("u", "v")) * alpha + gap(x, colours) * (1 - alpha), alpha)
        e = F.transform("best", lambda b: F.struct(b["q"].alias("q"), F.exp(F.exp(-b["cost"]) * sharp).alias("e")))
        found = found.withColumn("_e", e).withColumn("_s", F.aggregate("_e", F.lit(0.0), lambda acc, b: acc + b["e"]))
        each = found.select("t", "spix", "r", "_s", F.explode("_e").alias("b")).select("t", "spix", "r", F.col("b.q").alias("q"), (F.col("b.e") / F.col("_s")).alias("w"))
        each = each.join(before.select("t", "spix", "q", F.col(value).alias("_from")), ["t", "spix", "q"])
        each = each.groupBy("t", "spix", "r").agg(F.sum(F.col("w") * F.col("_from")).alias("warped"), F.collect_list(F.struct("q", "w")).alias("_qw"))
        out = out.unionByName(open_.join(each, ["t", "spix", "r"]).select("t", "spix", "r", "y", "x", F.col("_qw.q").alias("q"), F.col("_qw.w").alias("w"), "warped"))
    return out


def transport(p: DataFrame, best: int, alpha: float, sharp: float, unit: float, side: float) -> DataFrame:
    """t, spix, r, q, w: a row for each pixel r and each of the ``best`` pixels q that it chose (see _transported)."""
    out = _transported(p, best, alpha, sharp, unit, side, "c0")
    return out.select("t", "spix", "r", F.explode(F.arrays_zip("q", "w")).alias("_b")).select("t", "spix", "r", "_b.q", "_b.w")


def predicted(p: DataFrame, best: int, alpha: float, sharp: float, unit: float, side: float, value: str) -> DataFrame:
    """t, y, x, warped: carried_over() of the plan of transport() for one of the colours, without making the plan's rows."""
    return _transported(p, best, alpha, sharp, unit, side, value).select("t", "y", "x", "warped")


def carried_over(p: DataFrame, plan: DataFrame, value: str) -> DataFrame:
    """t, y, x, warped: each pixel's value predicted from the frame before by a transport plan (t, spix, r, q, w): the weighted sum of the pixels that it chose."""
    from tessera.operators.regions import rank_in_region

    a = rank_in_region(p.where("spix >= 0")).select("t", "spix", "y", "x", F.col("rank").alias("r"), F.col(value).alias("v"))
    before = a.select((F.col("t") + 1).alias("t"), "spix", F.col("r").alias("q"), F.col("v").alias("from"))
    sums = plan.join(before, ["t", "spix", "q"]).groupBy("t", "spix", "r").agg(F.sum(F.col("w") * F.col("from")).alias("warped"))
    return a.join(sums, ["t", "spix", "r"]).select("t", "y", "x", "warped")


def replacements(now: DataFrame, before: DataFrame, same: float, fresh: float) -> DataFrame:
    """For regions of a frame (spix, m_c0..) and those of the frame before: the nearest dead label, or itself, by mean colour.

    Only labels that are dead now, or the region's own, may be taken. ``id``: a dead label nearer than ``same``; else, if the
    region is further than ``fresh`` from its own past, a new number after the largest; else its own. Dead labels are few and are
    matched on a grid of colour cells of side ``same``, so each region meets only the cells around its own."""
    import itertools

    cell = [F.floor(F.col(f"m_c{k}") / same).cast("long") for k in range(3)]
    live = now.select("t", "spix")
    past = before.withColumn("t", F.col("t") + 1)
    dead = past.join(live, ["t", "spix"], "left_anti").select("t", F.col("spix").alias("cand"), *[F.col(f"m_c{k}").alias(f"d{k}") for k in range(3)], *[c.alias(f"g{k}") for k, c in enumerate(cell)])
    around = F.array(*[F.struct(*[(c + d).alias(f"g{k}") for k, (c, d) in enumerate(zip(cell, o, strict=True))]) for o in itertools.product((-1, 0, 1), repeat=3)])
    look = now.select("t", "spix", "m_c0", "m_c1", "m_c2", F.explode(around).alias("g")).select("t", "spix", "m_c0", "m_c1", "m_c2", "g.*")
    gap = sum((F.pow(F.col(f"m_c{k}") - F.col(f"d{k}"), 2) for k in range(3)), F.lit(0.0))
    near = look.join(dead, ["t", "g0", "g1", "g2"]).withColumn("d", F.sqrt(gap)).where(F.col("d") < same)
    near = near.groupBy("t", "spix").agg(F.min_by("cand", F.struct("d", "cand")).alias("revived"))
    own = now.join(past.select("t", "spix", *[F.col(f"m_c{k}").alias(f"d{k}") for k in range(3)]), ["t", "spix"], "left").withColumn("own", F.sqrt(gap))
    return own.join(near, ["t", "spix"], "left").select("t", "spix", "revived", (F.coalesce(F.col("own") > fresh, F.lit(False)) & F.col("revived").isNull()).alias("is_new"))
