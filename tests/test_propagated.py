"""Regions from the frame before in splits, merges and the loop; soft windows; buffers. Against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import assign, propagated, reshape

PRIOR = "t int, spix int, prior_count double, p_xx double, p_xy double, p_yy double"


def test_halves_and_priors(spark):
    # label 4 came along and its first half is gone; label 5 is new; one row of 8 pixels each
    rows = [(0, y, x, 10 * (x > 3), 0, 0, 4 + y, int(x > 3), x < 4) for y in range(2) for x in range(8)]
    h = spark.createDataFrame(rows, "t int, y int, x int, c0 int, c1 int, c2 int, spix int, half int, gone boolean")
    came = spark.createDataFrame([(0, 4)], "t int, spix int")
    s = {r.spix: r for r in propagated.split_scores(h, came, 0.5).collect()}
    assert (s[4].kept, s[4].swapped, s[4].came) == (1, True, True) and (s[5].kept, s[5].came) == (0, False)
    assert abs(s[5].score - s[4].score - 2) < 1e-9  # none of the kept half's pixels is gone
    ids = propagated.new_ids(h, propagated.split_scores(h, came, 0.5).withColumn("accepted", F.lit(True)))
    got = {(r.y, r.x): r.spix for r in propagated.divided(h, ids).collect()}
    assert [got[0, x] for x in (0, 7)] == [6, 4] and [got[1, x] for x in (0, 7)] == [5, 7]
    priors = spark.createDataFrame([(0, 4, 100.0, 3.0, 1.0, 2.0), (0, 5, 10.0, 3.0, 1.0, 2.0)], PRIOR)
    new = {r.spix: tuple(r)[2:] for r in propagated.split_priors(priors, ids).collect()}
    assert new == {4: (50.0, 1.0, 0.0, 1.0), 6: (50.0, 1.0, 0.0, 1.0), 5: (36.0, 1.0, 0.0, 1.0), 7: (36.0, 1.0, 0.0, 1.0)}


def test_merges_keep_what_came_along(spark):
    pairs = [(0, 2, 3), (0, 3, 2), (0, 4, 5), (0, 7, 6), (0, 9, 6), (0, 10, 11), (0, 11, 12)]
    came = spark.createDataFrame([(0, k) for k in range(0, 14, 2)], "t int, spix int")
    mixed = propagated.mixed_pairs(spark.createDataFrame([*pairs, (0, 2, 4)], "t int, f int, k int"), came)
    assert sorted((r.f, r.k) for r in mixed.collect()) == sorted(p[1:] for p in pairs)
    scored = mixed.select("t", "f", "k", F.lit(1.0).alias("score"), F.lit(True).alias("accepted"))
    won = propagated.claims(scored, mixed)
    # 2 and 3 want each other; 4 claims 5 and stays; 7 goes to 6 before 9; 10's target 11 goes to 12
    assert sorted((r.f, r.k) for r in won.collect()) == [(3, 2), (5, 4), (7, 6), (11, 12)]
    priors = spark.createDataFrame([(0, k, float(k), 1.0, 0.0, 1.0) for k in range(13)], PRIOR)
    left = {r.spix: r.prior_count for r in propagated.merged_priors(priors, won).collect()}
    assert left[2] == 5 and left[4] == 9 and left[6] == 13 and left[12] == 23 and sum(left.values()) == sum(range(13)) and not {3, 5, 7, 11} & set(left)


@pytest.mark.parametrize("width,splits", [(6, False), (3, True)])
def test_loop_keeps_priors_beside_regions(spark, width, splits):
    # regions are 6 wide. Stripes of 6: a region has one colour, and its score of about -4 isn't made up for by a bonus of 2. Stripes of 3: each has two
    rng = np.random.default_rng(2)
    rows = [(0, y, x, int(rng.integers(0, 5) + 30 * (x // width % 2)), 0, 0, x // 6, bool(x % 5 == 0)) for y in range(12) for x in range(24)]
    p = spark.createDataFrame(rows, "t int, y int, x int, c0 int, c1 int, c2 int, spix int, gone boolean")
    came = spark.createDataFrame([(0, 0), (0, 2)], "t int, spix int")
    priors = spark.createDataFrame([(0, k, 72.0, 3.0, 0.0, 12.0) for k in range(4)], PRIOR)
    out, kept = propagated.refined(p, came, priors, 8.0, 2)
    labels, known = {r.spix for r in out.select("spix").distinct().collect()}, {r.spix for r in kept.collect()}
    assert out.count() == 288 and labels <= known and {0, 2} <= known and (len(labels) > 4) == splits


def test_soft_windows_and_convolution(spark):
    rng = np.random.default_rng(4)
    v, w = rng.integers(0, 9, (3, 5, 6)), rng.random((3, 5, 6, 2))
    w /= w.sum(axis=-1, keepdims=True)
    at = list(np.ndindex(3, 5, 6))
    p = spark.createDataFrame([(*a, int(v[a]), [3, 8], w[a].tolist()) for a in map(tuple, at)], "t int, y int, x int, c0 int, cands array<int>, probs array<double>")
    got = {(r.t, r.y, r.x): r.attended for r in assign.attention_windows(p, "c0", 0.1, 1, 1, block=4, soft=True).collect()}
    kernel = np.array([[1.0, -2, 1], [0.5, 4, 0.5], [1, 2, 1]])
    conv = {k: {(r.t, r.y, r.x): r.conv for r in assign.similarity_conv(p, "c0", kernel.tolist(), k, k == "sum", block=3).collect()} for k in ("sum", "max")}
    for t, y, x in at:
        t0, y0, x0 = 0, min(max(y - 1, 0), 2), min(max(x - 1, 0), 3)
        e = np.exp(-0.1 * (v[t0 : t0 + 3, y0 : y0 + 3, x0 : x0 + 3] - v[t, y, x]) ** 2) * (w[t0 : t0 + 3, y0 : y0 + 3, x0 : x0 + 3] @ w[t, y, x])
        assert abs(got[t, y, x] - (e * v[t0 : t0 + 3, y0 : y0 + 3, x0 : x0 + 3]).sum() / (e.sum() + 1e-10)) < 1e-9
        near = [(i, j) for i in range(3) for j in range(3) if 0 <= y + i - 1 < 5 and 0 <= x + j - 1 < 6]
        like = {(i, j): w[t, y + i - 1, x + j - 1] @ w[t, y, x] for i, j in near}
        for normal, by in (("sum", sum(like.values())), ("max", max(like.values()))):
            weights = {k: kernel[k] * like[k] / (by + 1e-5) for k in near}
            want = sum(weights[i, j] * v[t, y + i - 1, x + j - 1] for i, j in near)
            want /= (sum(map(abs, weights.values())) + 1e-10) if normal == "sum" else 1
            assert abs(conv[normal][t, y, x] - want) < 1e-9


def test_softmax_of_far_colours_and_buffers(spark):
    p = spark.createDataFrame([(0, 0, 0, 1e4, 0.0, 0.0), (1, 0, 0, 0.0, 0.0, 0.0)], "t int, y int, x int, c0 double, c1 double, c2 double")
    means = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (0, 2, 1.0, 0.0, 0.0), (1, 7, 5.0, 0.0, 0.0)], "t int, spix int, m_c0 double, m_c1 double, m_c2 double")
    got = {(r.t, r.spix): r.p for r in assign.present_softmax(p, means, 1.0).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 7)} and got[1, 7] == 1 and abs(got[0, 2] - 1) < 1e-9 and got[0, 1] < 1e-9
    nan = float("nan")
    b = spark.createDataFrame([(0, 0, "br", 1.0), (0, 1, "br", nan), (0, 2, "br", 3.0), (0, 0, "bp", None)], "epoch int, frame int, metric string, value double")
    assert {(r.metric, r["mean"], r.n, r.n_all) for r in reshape.buffer_means(b, ["epoch"]).collect()} == {("br", 2.0, 2, 3), ("bp", None, 0, 1)}
    r = reshape.frame_columns(b, ["epoch"], ["br", "bp"], 3).first()
    assert (r.br_0, r.br_2, r.bp_0, r.bp_2) == (1.0, 3.0, None, None) and r.br_1 != r.br_1
