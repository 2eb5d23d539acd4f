"""Pixel view, videos with carried parameters, transport, windows and scales against plain versions."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import assign, metrics, segment
from tessera.plans import pixels
from tessera.streaming import frames, video


def table(spark, grids, labels=None):
    """Frames of c0 (grids[t][y][x]) and labels."""
    rows = [(t, y, x, float(v), float(v % 3), 1.0, int(labels[t][y][x]) if labels is not None else int(v)) for t, g in enumerate(grids) for y, row in enumerate(g) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, "t int, y int, x int, c0 double, c1 double, c2 double, spix int")


@pytest.mark.parametrize("sf,rows", [("sf0.001", 6_000), ("sf0.01", 60_000), ("sf0.1", 600_000)])
def test_every_row_is_a_pixel_of_a_bounded_frame(spark, sf, rows):
    p = pixels.pixels(spark, f"/root/testdata/{sf}")
    r = p.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t", "y", "x").alias("places"), F.max("y").alias("y"), F.max("x").alias("x"), F.min("spix").alias("least")).first()
    assert (r.n, r.places) == (rows, rows) and r.y < pixels.HEIGHT and r.x == pixels.WIDTH - 1 and r.least >= 0


def test_view_is_stored_again_when_it_has_been_cleared(spark):
    import shutil

    root = "/root/testdata/sf0.001"
    assert pixels.pixels(spark, root).count() == 6_000
    path = pixels._STORED[spark.sparkContext.applicationId, root]
    shutil.rmtree(path.removeprefix("file:"))
    assert pixels.pixels(spark, root).count() == 6_000 and pixels._STORED[spark.sparkContext.applicationId, root] != path


def test_frames_are_numbered_without_a_task_per_video(spark):
    """One video holds nearly all frames."""
    rng = random.Random(2)
    rows = [(7 if k % 50 else k, rng.randrange(10_000), k, float(rng.randrange(9))) for k in range(2000)]
    df = spark.createDataFrame(rows, "video long, ts long, id long, value double")
    from tessera.operators.order import ranked

    got = {r.id: (r.frame, r.change) for r in frames.ordered(df, "video", ["ts", "id"]).collect()}
    by = collections.defaultdict(list)
    for v, ts, k, value in rows:
        by[v].append((ts, k, value))
    want = {}
    for some in by.values():
        some.sort()
        want |= {k: (n, None if n == 0 else value - some[n - 1][2]) for n, (_, k, value) in enumerate(some)}
    assert got == want
    small = {(r.video, r.id): r.place for r in ranked(df, ["video"], ["ts", "id"], "place", part_rows=70).collect()}
    assert small == {(v, k): want[k][0] for v, _, k, _ in rows}


def region_rows(seed):
    rng = random.Random(seed)
    rows = []
    for v in range(2):
        for f in range(8):
            for s in range(5):
                if rng.random() < 0.7:
                    a, b = rng.random() * 50 + 1, rng.random() * 50 + 1
                    rows.append((v, f, s, rng.randrange(1, 90), a, rng.random() * min(a, b), b))
    return rows


REGIONS = "video int, frame int, spix int, n long, sxx double, sxy double, syy double"


def plain_fold(rows, known=None):
    known, out = dict(known or {}), {}
    for v, f, s, n, *spread in sorted(rows):
        known[v, s] = video.advance(known.get((v, s)), n, spread)
        out[v, f, s] = (n, *(round(x, 9) for x in known[v, s][1:]))
    return out, known


def test_batch_fold_of_two_videos(spark):
    rows = region_rows(1)
    got = video.carried_parameters(spark.createDataFrame(rows, REGIONS).repartition(3)).collect()
    assert {(r.video, r.frame, r.spix): (r.n, *(round(x, 9) for x in (r.xx, r.xy, r.yy))) for r in got} == plain_fold(rows)[0] and len(got) == len(rows)


@pytest.mark.parametrize("resume", [False, True])
def test_stream_of_two_videos_is_the_batch(spark, tmp_path, resume):
    """Frames arrive out of order and some twice; the later run goes on from where a batch over the first frames has ended."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [r for r in region_rows(5)]
    first = 3 if resume else 0
    early, late = [r for r in rows if r[1] < first], [r for r in rows if r[1] >= first]
    _, known = plain_fold(early)
    want = {k: v for k, v in plain_fold(rows)[0].items() if k[1] >= first}
    packed = [tuple(r) for r in video.as_frames(spark.createDataFrame(late, REGIONS)).collect()]
    assert {r[:2] for r in packed} == {(v, f) for v in range(2) for f in range(first, 8)}, "every frame has a region here"
    random.Random(4).shuffle(packed)
    schema = "video int, frame int, spix array<int>, n array<bigint>, sxx array<double>, sxy array<double>, syy array<double>"
    for k in range(3):
        spark.createDataFrame([*packed[k::3], packed[0]], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    start = spark.createDataFrame([(v, first, s, *p) for (v, s), p in known.items()], "video int, frame int, spix int, count double, xx double, xy double, yy double") if resume else None
    name = f"carried_{resume}".lower()
    q = video.carried_stream(stream, start).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table(name).collect()
    assert {(r.video, r.frame, r.spix): (r.n, *(round(x, 9) for x in (r.xx, r.xy, r.yy))) for r in got} == want and len(got) == len(want)


def test_keys_of_videos_leave_a_gap(spark):
    p = spark.createDataFrame([(0, 5), (1, 0), (127, 65534)], "video int, frame int")
    keys = [r.t for r in video.keyed(p).orderBy("video").collect()]
    assert keys == [5, 65536, 127 * 65536 + 65534] and keys[1] - 1 not in keys and keys[2] < 1 << 23
    assert sorted(map(tuple, video.unkeyed(video.keyed(p).select("t")).collect())) == sorted(map(tuple, p.collect()))
    with pytest.raises(Exception, match="videos must be"):
        video.keyed(spark.createDataFrame([(128, 0)], "video int, frame int")).collect()


@pytest.mark.parametrize("alpha,side,unit", [(0.9, 2.0, 1.0), (0.5, 0.1, 16.0), (0.2, 8.0, 1.0)])
def test_transport_is_that_of_all_pairs(spark, alpha, side, unit):
    """Large and small regions, missing labels, equal costs; wide rings and early ends."""
    rng = np.random.default_rng(int(alpha * 10))
    grids = rng.integers(0, 4, (3, 14, 17))
    labels = np.where(rng.random((3, 14, 17)) < 0.1, rng.integers(-1, 5, (3, 14, 17)), (np.arange(17) // 9)[None, None, :])
    labels[:, 0, 0] = 9
    plan = collections.defaultdict(list)
    for r in segment.transport(table(spark, grids, labels), 5, alpha, 2.0, unit, side).collect():
        plan[r.t, r.spix, r.r].append((r.q, r.w))

    def members(t, s):
        at = [(y, x) for y in range(14) for x in range(17) if labels[t][y][x] == s]
        my, mx = np.mean([a[0] for a in at]), np.mean([a[1] for a in at])
        return [((x - mx) / unit, (y - my) / unit, grids[t][y][x], grids[t][y][x] % 3) for y, x in at]

    want = {}
    for t in (1, 2):
        for s in set(labels[t].ravel().tolist()) & set(labels[t - 1].ravel().tolist()) - {-1}:
            before = members(t - 1, s)
            for r, (u, v, c, d) in enumerate(members(t, s)):
                cost = sorted((round(alpha * np.hypot(u - a, v - b) + (1 - alpha) * np.hypot(c - e, d - f), 9), q) for q, (a, b, e, f) in enumerate(before))[:5]
                e = np.exp(2 * np.exp([-c for c, _ in cost]))
                want[t, s, r] = [(q, w) for (_, q), w in zip(cost, e / e.sum(), strict=True)]
    assert plan.keys() == want.keys()
    for k, chosen in want.items():
        assert sorted(q for q, _ in plan[k]) == sorted(q for q, _ in chosen), k
        assert np.allclose([w for _, w in sorted(plan[k])], [w for _, w in sorted(chosen)])


def test_nearest_of_far_and_crowded_centres(spark):
    rng = np.random.default_rng(3)
    pts = [(t, y, x, float(rng.normal() * 30), float(rng.normal() * 30)) for t in range(2) for y in range(10) for x in range(12)]
    centres = [(t, k, float(rng.normal() * 5 + (300 if k == 0 else 0)), float(rng.normal() * 5)) for t in range(2) for k in range(20)] + [(1, 50, 300.0, 300.0), (1, 51, 300.0, 300.0)]
    p, c = spark.createDataFrame(pts, "t int, y int, x int, px double, py double"), spark.createDataFrame(centres, "t int, spix int, cx double, cy double")
    found = assign.nearest_centres(p, c, 3.0)
    got = {(r.t, r.y, r.x): r.spix for r in found.collect()}
    assert got == {(t, y, x): min((round(np.hypot(px - cx, py - cy), 9), k) for u, k, cx, cy in centres if u == t)[1] for t, y, x, px, py in pts}
    assert "Cartesian" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()


def test_bonus_of_frames(spark):
    """Grows outside the band, starts anew on its other side, and is nothing in it."""
    have = spark.createDataFrame([(0, 20), (1, 20), (2, 3), (3, 10)], "t int, have long")
    before = spark.createDataFrame([(0, -4.0), (1, 6.0), (2, 2.0), (3, 8.0)], "t int, bonus double")
    got = {r.t: (r.bonus, r.inside) for r in segment.steered(have, before, 10.0, 0.05, 2.0).collect()}
    assert got == {0: (-6.0, False), 1: (-2.0, False), 2: (4.0, False), 3: (0.0, True)}


def test_refinement_ends_in_the_band(spark):
    """A frame that starts in the band stays as it is; one with twice as many regions ends in it."""
    rng = np.random.default_rng(1)
    colour = lambda y, x: 10 if (x // 4 + y // 4) % 2 else 40
    grids = [[[colour(y, x) + int(rng.integers(3)) for x in range(16)] for y in range(16)] for _ in range(2)]
    labels = [[[(y // 4) * 4 + x // 4 for x in range(16)] for y in range(16)], [[(y // 4) * 8 + x // 2 for x in range(16)] for y in range(16)]]
    out = segment.refined(table(spark, grids, labels), 16.0, 8, sigma2=1.0, slack=0.13, step=4.0).collect()
    have = [{r.spix for r in out if r.t == t} for t in (0, 1)]
    assert len(have[0]) == 16 and 14 <= len(have[1]) <= 18 and len(out) == 512
    assert all(r.spix == labels[0][r.y][r.x] for r in out if r.t == 0)


def test_scales_on_odd_sides(spark):
    rng = np.random.default_rng(9)
    a = rng.random((2, 21, 27))
    b = np.clip(a + rng.normal(0, 0.1, a.shape), 0, 1)
    rows = [(t, y, x, float(a[t, y, x]), float(b[t, y, x])) for t in range(2) for y in range(21) for x in range(27)]
    got = {r.t: r.ms_ssim for r in metrics.ms_ssim(spark.createDataFrame(rows, "t int, y int, x int, a double, b double"), "a", "b", size=5, weights=metrics.SCALES[:3]).collect()}
    w = np.array(metrics.gaussian(5))

    def smooth(v):
        v = sum(w[k] * v[:, k : v.shape[1] - 4 + k] for k in range(5))
        return sum(w[k] * v[k : v.shape[0] - 4 + k] for k in range(5))

    def half(v):
        v = np.pad(v, [(s % 2, s % 2) for s in v.shape])
        v = v[: v.shape[0] // 2 * 2, : v.shape[1] // 2 * 2]
        return (v[::2, ::2] + v[1::2, ::2] + v[::2, 1::2] + v[1::2, 1::2]) / 4

    for t in range(2):
        x, y, out = a[t], b[t], 1.0
        for k, weight in enumerate(metrics.SCALES[:3]):
            mx, my = smooth(x), smooth(y)
            cs = (2 * (smooth(x * y) - mx * my) + 9e-4) / (smooth(x * x) - mx * mx + smooth(y * y) - my * my + 9e-4)
            value = (cs * (2 * mx * my + 1e-4) / (mx * mx + my * my + 1e-4)).mean() if k == 2 else cs.mean()
            out *= max(value, 0) ** weight
            x, y = half(x), half(y)
        assert abs(got[t] - out) < 1e-9
    tiny = spark.createDataFrame([(0, 0, 0, 0.5, 0.5)], "t int, y int, x int, a double, b double")
    assert [r.ms_ssim for r in metrics.ms_ssim(tiny, "a", "b").collect()] == [None]


@pytest.mark.parametrize("radius,span,same,block", [(1, 0, False, 4), (2, 1, True, 5), (3, 2, False, 32)])
def test_windows_shift_at_borders(spark, radius, span, same, block):
    rng = np.random.default_rng(radius)
    grids, labels = rng.integers(0, 9, (4, 9, 11)), rng.integers(0, 3, (4, 9, 11))
    p = table(spark, grids, labels).where("not (t = 2 and y = 8 and x > 6)")  # a short last line
    got = {(r.t, r.y, r.x): r.attended for r in assign.attention_windows(p, "c0", 0.05, radius, span, same, block).collect()}
    there = {(r.t, r.y, r.x) for r in p.select("t", "y", "x").collect()}
    assert got.keys() == there
    for t, y, x in there:
        lo = [max(0, min(c - r, n - 1 - 2 * r)) for c, r, n in ((t, span, 4), (y, radius, 9), (x, radius, 11))]
        cells = [tuple(a + b for a, b in zip(lo, q, strict=True)) for q in np.ndindex(2 * span + 1, 2 * radius + 1, 2 * radius + 1)]
        cells = [q for q in cells if q in there and (not same or labels[q] == labels[t, y, x])]
        w = np.exp([-0.05 * (grids[q] - grids[t, y, x]) ** 2 for q in cells])
        assert abs(got[t, y, x] - (w * [grids[q] for q in cells]).sum() / w.sum()) < 1e-9


def test_projection_is_that_of_the_singular_vectors(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6))
    got = {r.id: r.projected for r in assign.principal_projection(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id int, v array<double>"), 2).collect()}
    z = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, ddof=1, keepdims=True)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    sign = np.sign(vt[np.arange(2), np.abs(vt[:2]).argmax(axis=1)])
    assert np.allclose([got[k] for k in range(80)], u[:, :2] * s[:2] * sign)
    assert assign.principal_projection(spark.createDataFrame([], "id int, v array<double>"), 2).count() == 0


def cells_of(labels):
    """Components of equal labels, eight neighbours, by flood fill: number of each pixel's component, in the order of their first pixels."""
    h, w = len(labels), len(labels[0])
    out = [[None] * w for _ in range(h)]
    for y in range(h):
        for x in range(w):
            if out[y][x] is None:
                todo, out[y][x] = [(y, x)], (y, x)
                while todo:
                    a, b = todo.pop()
                    for c in range(max(0, a - 1), min(h, a + 2)):
                        for d in range(max(0, b - 1), min(w, b + 2)):
                            if out[c][d] is None and labels[c][d] == labels[y][x]:
                                out[c][d] = (y, x)
                                todo.append((c, d))
    return out


def plain_bounded(labels, least, most):
    """The same rule on one frame with sets."""
    h, w = len(labels), len(labels[0])
    unit = h * w / (max(v for row in labels for v in row) + 1)
    low, high = int(unit * least), int(unit * most)
    region = cells_of(labels)
    count = collections.Counter(r for row in region for r in row)
    side = max(1, int(high**0.5))
    region = cells_of([[(region[y][x], (y // side, x // side) if count[region[y][x]] > high else None) for x in range(w)] for y in range(h)])
    code = lambda r: r[0] * (1 << 20) + r[1]
    now = [[code(region[y][x]) for x in range(w)] for y in range(h)]
    while True:
        count = collections.Counter(r for row in now for r in row)
        edges = collections.Counter()
        for y in range(h):
            for x in range(w):
                for c, d in ((y + 1, x), (y, x + 1)):
                    if c < h and d < w and now[c][d] != now[y][x]:
                        edges[now[y][x], now[c][d]] += 1
                        edges[now[c][d], now[y][x]] += 1
        root = {r: r for r in count}

        def find(r, root=root):
            while root[r] != r:
                r = root[r]
            return r

        picks = 0
        for u, n in count.items():
            around = [(n_, -min(u, b), -max(u, b), b) for (a, b), n_ in edges.items() if a == u]
            if n < low and around:
                picks += 1
                a, b = find(u), find(max(around)[3])
                root[max(a, b)] = min(a, b)
        if not picks:
            return now
        now = [[find(r) for r in row] for row in now]


@pytest.mark.parametrize("least,most,k", [(0.3, 3.0, 12), (1.0, 1.5, 3), (0.0, 0.2, 2), (50.0, 90.0, 40)])
def test_bounded_regions(spark, least, most, k):
    from tessera.operators import components

    rng = np.random.default_rng(k)
    labels = [[[int(rng.integers(k)) if rng.random() < 0.3 else (y // 5 * 3 + x // 6) % k for x in range(17)] for y in range(13)] for _ in range(2)]
    got = {(r.t, r.y, r.x): r.region - (r.t << 40) for r in components.bounded(table(spark, labels), least, most).collect()}
    for t in range(2):
        want = plain_bounded(labels[t], least, most)
        assert all(got[t, y, x] == want[y][x] for y in range(13) for x in range(17))
        sizes = collections.Counter(v for row in want for v in row)
        unit = 13 * 17 / (max(v for row in labels[t] for v in row) + 1)
        assert min(sizes.values()) >= int(unit * least) or len(sizes) == 1


def test_forward_and_backward_is_frame_after_frame(spark):
    """All frames but the last go together; a plain run takes them one by one."""
    rng = np.random.default_rng(8)
    grids = [[[10 * ((x + t) // 4 % 2) + int(rng.integers(4)) for x in range(12)] for y in range(8)] for t in range(3)]
    labels = [[[(x + int(rng.integers(2))) // 4 for x in range(12)] for y in range(8)] for t in range(3)]
    p = table(spark, grids, labels)
    now = {t: p.where(F.col("t") == t) for t in range(3)}
    start = {t: segment.priors_of(now[t]) for t in range(3)}
    done = {}
    for t in range(3):
        after = start[t + 1] if t < 2 else segment.priors_of(done[0])
        done[t] = segment.refined_with(now[t], after.withColumn("t", F.lit(t)), 1, 4.0, 0.5).cache()
    want = {(r.t, r.y, r.x): r.spix for t in range(3) for r in done[t].collect()}
    got = {(r.t, r.y, r.x): r.spix for r in segment.forward_backward(p, 1, 1, 4.0, 0.5).collect()}
    assert got == want and got != {(t, y, x): labels[t][y][x] for t in range(3) for y in range(8) for x in range(12)}
    assert segment.forward_backward(now[0], 1, 1, 4.0, 0.5).count() == 96
