"""Connected components of equal labels, and what follows from them: invalidation, filling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.geometry import nearness
from tessera.operators.lineage import cut, dropped
from tessera.operators.neighbours import along_column, along_row, four


def stars(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """u, v with v the least node that u reaches: a node's larger neighbours, then its smaller ones, are linked to the least
    around it, until nothing changes (the number of rounds grows with the logarithm of a component, not its diameter)."""
    now, mark = cut(edges), None
    for _ in range(rounds):
        table = now
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        now = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        moved = now.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        now = cut(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
        dropped(table)
        row = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if row == mark:
            return now
        mark = row
    raise RuntimeError(f"no fixed point within {rounds} rounds")


def components(p: DataFrame, label: str = "spix", rounds: int = 40) -> DataFrame:
    """Adds region: the least pixel number (y, then x) of the pixel's 8-connected component of equal labels in its frame.

    Runs along a row are found by a window; only runs that touch in neighbouring rows become edges."""
    size = F.lit(1 << 20)
    fits = F.col("t").between(0, (1 << 23) - 1) & F.col("y").between(0, (1 << 20) - 1) & F.col("x").between(0, (1 << 20) - 1)
    code = F.when(fits, (F.col("t").cast("long") * size + F.col("y")) * size + F.col("x")).otherwise(F.raise_error(F.lit("frames must be below 2^23, rows and columns below 2^20")))
    starts = F.coalesce(F.lag(label).over(along_row()) != F.col(label), F.lit(True))
    runs = cut(p.withColumn("_run", F.max(F.when(starts, code)).over(along_row().rowsBetween(W.unboundedPreceding, 0))))
    me = F.struct(F.col(label).alias("l"), F.col("_run").alias("r"))
    # only what the windows read, dealt out by frame: both share one exchange
    three = runs.select("t", "y", "x", label, "_run").repartition("t").withColumn("_me", me).withColumn("_three", F.array(F.lag("_me").over(along_row()), F.col("_me"), F.lead("_me").over(along_row())))
    up = three.withColumn("_up", F.lag("_three").over(along_column())).select(F.col("_run").alias("u"), F.col(label).alias("_l"), F.explode("_up").alias("o"))
    edges = up.where((F.col("o.l") == F.col("_l")) & (F.col("o.r") < F.col("u"))).select("u", F.col("o.r").alias("v")).distinct()
    roots = stars(edges, rounds)
    out = runs.join(roots.withColumnRenamed("u", "_run").withColumnRenamed("v", "_root"), "_run", "left")
    return out.withColumn("region", F.coalesce("_root", "_run")).drop("_run", "_root")


def component_sizes(c: DataFrame, label: str = "spix") -> DataFrame:
    return c.where(F.col(label) >= 0).groupBy("t", label, "region").agg(F.count(F.lit(1)).alias("size"))


def largest_only(p: DataFrame, rounds: int = 40) -> DataFrame:
    """Pixels outside the largest component of their label (ties: the one that starts first) become -1."""
    c = cut(components(p, rounds=rounds))
    best = component_sizes(c).groupBy("t", "spix").agg(F.max_by("region", F.struct(F.col("size"), -F.col("region"))).alias("best"))
    j = c.join(best, ["t", "spix"], "left")
    return j.withColumn("spix", F.when(F.col("region") == F.col("best"), F.col("spix")).otherwise(-1)).drop("region", "best")


def fill_step(p: DataFrame, centres: DataFrame, parity: tuple[int, int], width: int) -> DataFrame:
    """Missing pixels of one parity (x % 2, y % 2) that have a labelled neighbour take the label of the one whose region centre (mu_x, mu_y) is nearest;
    ties: north, south, west, east."""
    n = four(p, "spix")
    chosen = n.where((F.col("spix") < 0) & (F.col("x") % 2 == parity[0]) & (F.col("y") % 2 == parity[1]))
    cand = chosen.select("t", "y", "x", F.posexplode(F.array("n", "s", "w", "e")).alias("k", "c")).where("c >= 0")
    tall = p.groupBy("t").agg((F.max("y") + 1).alias("hh"))
    j = cand.join(centres.select("t", F.col("spix").alias("c"), "mu_x", "mu_y"), ["t", "c"]).join(tall, "t")
    score = nearness(F.col("x"), F.col("y"), F.col("mu_x"), F.col("mu_y"), F.lit(width), F.col("hh"))
    best = j.groupBy("t", "y", "x").agg(F.max_by("c", F.struct(score, -F.col("k"))).alias("_new"))
    return p.join(best, ["t", "y", "x"], "left").withColumn("spix", F.coalesce("_new", "spix")).drop("_new")


def filled(p: DataFrame, centres: DataFrame, width: int, rounds: int = 1000) -> DataFrame:
    """Passes over the four parities until no pixel is missing, each as in fill_step. Only missing pixels and the labels beside them take part; their labels are written back once."""
    holes = cut(p.where("spix < 0").select("t", "y", "x"))
    total = holes.count()
    if not total:
        return p
    sides = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("y") + dy).alias("ny"), (F.col("x") + dx).alias("nx")) for k, (dy, dx) in enumerate(((-1, 0), (1, 0), (0, -1), (0, 1)))])
    links = holes.select("t", "y", "x", F.explode(sides).alias("o")).select("t", "y", "x", "o.*")
    links = links.join(p.select("t", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("spix").alias("c")), ["t", "ny", "nx"])
    tall = p.groupBy("t").agg((F.max("y") + 1).alias("hh"))
    links = cut(links.join(tall, "t"))
    given, between = links.where("c >= 0").drop("ny", "nx"), links.where("c < 0").drop("c")
    found, have = None, 0
    score = nearness(F.col("x"), F.col("y"), F.col("mu_x"), F.col("mu_y"), F.lit(width), F.col("hh"))
    middle = centres.select("t", F.col("spix").alias("c"), "mu_x", "mu_y")
    for _ in range(rounds):
        for parity in ((0, 0), (0, 1), (1, 0), (1, 1)):
            now = lambda df: df.where((F.col("x") % 2 == parity[0]) & (F.col("y") % 2 == parity[1]))  # noqa: B023, E731
            cand = now(given)
            if found is not None:
                beside = found.select("t", F.col("y").alias("ny"), F.col("x").alias("nx"), "c")
                cand = cand.unionByName(now(between).join(beside, ["t", "ny", "nx"]).drop("ny", "nx")).join(found.select("t", "y", "x"), ["t", "y", "x"], "left_anti")
            new = cut(cand.join(middle, ["t", "c"]).groupBy("t", "y", "x").agg(F.max_by("c", F.struct(score, -F.col("k"))).alias("c")))
            found = new if found is None else found.unionByName(new)
        found = cut(found)
        before, have = have, found.count()
        if have == total:
            return p.join(found.withColumnRenamed("c", "_new"), ["t", "y", "x"], "left").withColumn("spix", F.coalesce("_new", "spix")).drop("_new")
        if have == before:
            raise ValueError("no labelled pixel next to the missing ones")
    raise RuntimeError("not filled within the rounds")


def propagated(p: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Labels of the next frame from those of this one and its flow (dx, dy): they move, missing pixels are filled, all but the largest component of a label
    becomes missing, and is filled again. Returns t, y, x, spix, and per region t, spix, n_shifted, n_filled, invalid_ratio (the
    share of its pixels that filling gave it)."""
    from tessera.operators.warp import shifted_labels

    def full(q: DataFrame) -> DataFrame:
        centres = q.where("spix >= 0").groupBy("t", "spix").agg(F.avg("x").alias("mu_x"), F.avg("y").alias("mu_y"))
        return filled(q, centres, width)

    moved = cut(shifted_labels(p))
    out = full(largest_only(full(moved)))
    count = lambda q, name: q.where("spix >= 0").groupBy("t", "spix").agg(F.count(F.lit(1)).alias(name))
    per = count(out, "n_filled").join(count(moved, "n_shifted"), ["t", "spix"], "left").withColumn("n_shifted", F.coalesce("n_shifted", F.lit(0)))
    return out, per.withColumn("invalid_ratio", (F.col("n_filled") - F.col("n_shifted")) / (F.col("n_filled") + 1e-8))


def bounded(p: DataFrame, least: float = 0.3, most: float = 3.0, rounds: int = 40) -> DataFrame:
    """Connected regions of bounded size: t, y, x, spix, region (least pixel number of the region). least and most are in units of a frame's pixels over its labels (from 0 to the largest).

    Components of equal labels that are larger than the upper bound are divided by tiles, whose side makes every piece small enough, and pieces are components again. Then regions
    smaller than the lower bound join: each takes the neighbour with which it shares the longest border (ties by numbers), and regions linked so become one, round by round,
    until none is too small or a frame is one region. Only regions, their sizes and borders take part in the rounds; pixels are relabelled once. What small
    regions join may so become larger than the upper bound."""
    size = p.groupBy("t").agg(F.count(F.lit(1)).alias("_n"), (F.max("spix") + 1).alias("_k"))
    size = size.select("t", F.floor(F.col("_n") / F.col("_k") * least).alias("_least"), F.floor(F.col("_n") / F.col("_k") * most).alias("_most"))
    whole = cut(components(p.select("t", "y", "x", "spix"), rounds=rounds))
    wide = whole.groupBy("t", "region").agg(F.count(F.lit(1)).alias("_size")).join(size, "t")
    side = F.greatest(F.floor(F.sqrt("_most")), F.lit(1))
    q = whole.join(wide, ["t", "region"]).withColumn("_tile", F.when(F.col("_size") > F.col("_most"), F.floor(F.col("y") / side) * (1 << 20) + F.floor(F.col("x") / side)).otherwise(-1))
    q = q.select("t", "y", "x", "spix", F.struct("region", "_tile").alias("_piece"))
    q = cut(components(q, "_piece", rounds).drop("_piece"))
    dropped(whole)
    sizes = cut(q.groupBy("t", "region").agg(F.count(F.lit(1)).alias("size")).join(size.select("t", "_least"), "t"))
    edges = cut(_borders(q))
    known = cut(sizes.select("t", "region", F.col("region").alias("root")))
    for _ in range(rounds):
        small = sizes.where(F.col("size") < F.col("_least")).select("t", F.col("region").alias("u"))
        # an order of edges that both ends share, so that picks make trees
        place = F.struct(F.col("w").alias("w"), (-F.least("u", "v")).alias("a"), (-F.greatest("u", "v")).alias("b"))
        picks = cut(edges.join(small, ["t", "u"]).groupBy("t", "u").agg(F.max_by("v", place).alias("v")).select("u", "v"))
        if picks.isEmpty():
            return q.join(known, ["t", "region"]).select("t", "y", "x", "spix", F.col("root").alias("region"))
        to = stars(picks.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rounds).select(F.col("u").alias("_u"), F.col("v").alias("_v"))
        moved = lambda df, c: df.join(to, F.col(c) == F.col("_u"), "left").withColumn(c, F.coalesce("_v", c)).drop("_u", "_v")
        old = sizes, edges, known, picks
        sizes = cut(moved(sizes, "region").groupBy("t", "region").agg(F.sum("size").alias("size"), F.first("_least").alias("_least")))
        edges = cut(moved(moved(edges, "u"), "v").where("u != v").groupBy("t", "u", "v").agg(F.sum("w").alias("w")))
        known = cut(moved(known, "root"))
        dropped(*old)
    raise RuntimeError(f"regions are still too small after {rounds} rounds")


def _borders(q: DataFrame) -> DataFrame:
    """t, u, v, w: how many pairs of neighbouring pixels two regions have, both ways."""
    two = q.select("t", "y", "x", "region").repartition("t").select("t", F.col("region").alias("u"), F.lead("region").over(along_row()).alias("_e"), F.lead("region").over(along_column()).alias("_s"))
    each = two.select("t", "u", F.explode(F.array("_e", "_s")).alias("v")).where("v is not null and u != v")
    return each.union(each.select("t", "v", "u")).groupBy("t", "u", "v").agg(F.count(F.lit(1)).alias("w"))
