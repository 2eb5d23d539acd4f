"""Iterative operators against brute force and invariants; sources by round trips; streams against batch."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import assign, components, neighbours, regions, segment
from tessera.sources import rasters


def raster(spark, grid, t=0):
    rows = [(t, y, x, v, 1, 2, v) for y, row in enumerate(grid) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, "t int, y int, x int, c0 int, c1 int, c2 int, spix int")


def noise(h, w, k, seed):
    r = random.Random(seed)
    return [[r.randrange(k) for _ in range(w)] for _ in range(h)]


def flood(grid, four=False):
    h, w = len(grid), len(grid[0])
    out = [[None] * w for _ in range(h)]
    for y in range(h):
        for x in range(w):
            if out[y][x] is None:
                todo, out[y][x] = [(y, x)], (y, x)
                while todo:
                    a, b = todo.pop()
                    for i in (-1, 0, 1):
                        for j in (-1, 0, 1):
                            if four and abs(i) + abs(j) > 1:
                                continue
                            c, d = a + i, b + j
                            if 0 <= c < h and 0 <= d < w and out[c][d] is None and grid[c][d] == grid[y][x]:
                                out[c][d] = (y, x)
                                todo.append((c, d))
    return out


@pytest.mark.parametrize("k", [1, 2, 4])
def test_components_are_the_flood_fill(spark, k):
    grid = noise(9, 11, k, k)
    got = {(r.y, r.x): r.region for r in components.components(raster(spark, grid)).collect()}
    want = flood(grid)
    size = 1 << 20
    assert got == {(y, x): want[y][x][0] * size + want[y][x][1] for y in range(9) for x in range(11)}


def test_largest_only_leaves_one_component_per_label(spark):
    rows = components.largest_only(raster(spark, noise(9, 11, 3, 5))).collect()
    grid = [[-1] * 11 for _ in range(9)]
    for r in rows:
        grid[r.y][r.x] = r.spix
    roots = flood(grid)
    per = {}
    for y in range(9):
        for x in range(11):
            if grid[y][x] >= 0:
                per.setdefault(grid[y][x], set()).add(roots[y][x])
    assert per and all(len(v) == 1 for v in per.values())


def test_fill_leaves_nothing_missing_and_keeps_the_rest(spark):
    grid = [[-1 if (x + y) % 3 == 0 else (0 if x < 4 else 1) for x in range(8)] for y in range(6)]
    p = raster(spark, grid)
    got = {(r.y, r.x): r.spix for r in components.filled(p, regions.summary(regions.moments(p)), 8).collect()}
    assert len(got) == 48 and min(got.values()) >= 0
    assert all(got[y, x] == grid[y][x] for y in range(6) for x in range(8) if grid[y][x] >= 0)


def test_fill_without_any_label_fails(spark):
    p = raster(spark, [[-1, -1], [-1, -1]])
    with pytest.raises(ValueError):
        components.filled(p, regions.summary(regions.moments(p)), 2)


def test_simple_points_keep_regions_connected():
    """Taking a pixel away that the table calls simple leaves its equal side neighbours connected around it."""
    table = neighbours.simple_points()
    ring = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
    for bits in range(256):
        grid = [[0] * 3 for _ in range(3)]
        for i, (dy, dx) in enumerate(ring):
            grid[1 + dy][1 + dx] = bits >> i & 1
        grid[1][1] = 2
        roots = flood(grid, four=True)
        sides = {roots[1 + dy][1 + dx] for i, (dy, dx) in enumerate(ring) if abs(dy) + abs(dx) == 1 and bits >> i & 1}
        assert table[bits] == (len(sides) == 1 and bits != 255)


def test_potts_step_changes_border_pixels_only(spark):
    p = raster(spark, [[0 if x < 4 + (y % 2) else 1 for x in range(8)] for y in range(6)])
    from tessera.functions import geometry

    s = regions.summary(regions.moments(p))
    c = [F.col(k) for k in ("xx", "xy", "yy")]
    s = s.select("t", "spix", "n", *[f"mu_{k}" for k in ("c0", "c1", "c2", "x", "y")], *[v.alias(k) for v, k in zip(geometry.inverse(*c), ("i_xx", "i_xy", "i_yy"), strict=True)], geometry.log_det(*c).alias("logdet"))
    before = {(r.y, r.x): (r.spix, r.border) for r in neighbours.border(p).collect()}
    after = {(r.y, r.x): r.spix for r in segment.move_labels(p, s, (0, 0), 1.0, 0.5).collect()}
    assert all(after[k] == v or b for k, (v, b) in before.items())
    assert all(after[k] == v for k, (v, _) in before.items() if k[0] % 2 or k[1] % 2)


def test_soft_assignment_sums_to_one(spark):
    p = raster(spark, noise(12, 12, 5, 1))
    sums = assign.slic(p, 4, 12, 0.1, 3).groupBy("t", "y", "x").agg(F.sum("p").alias("s")).collect()
    assert len(sums) == 144 and all(abs(r.s - 1) < 1e-9 for r in sums)


def test_labels_and_flow_round_trip(spark, tmp_path):
    p = raster(spark, noise(5, 7, 9, 2)).select("t", "y", "x", "spix")
    rasters.write_labels(p, str(tmp_path / "labels"))
    assert sorted(map(tuple, rasters.read_written_labels(spark, str(tmp_path / "labels")).collect())) == sorted(map(tuple, p.collect()))
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "00003.csv").write_text("1,2\n3,4\n")
    assert sorted(map(tuple, rasters.read_labels(spark, str(tmp_path / "csv")).collect())) == [(3, 0, 0, 1), (3, 0, 1, 2), (3, 1, 0, 3), (3, 1, 1, 4)]
    dx, dy = np.arange(6, dtype=float).reshape(2, 3), -np.arange(6, dtype=float).reshape(2, 3)
    (tmp_path / "flo").mkdir()
    (tmp_path / "flo" / "00001.flo").write_bytes(rasters.encode_flow(dx, dy))
    flow = rasters.read_flow(spark, str(tmp_path / "flo"))
    assert sorted((r.y, r.x, r.dx, r.dy) for r in flow.collect()) == [(y, x, dx[y, x], dy[y, x]) for y in range(2) for x in range(3)]
    assert bytes(rasters.flow_files(flow).first().content) == rasters.encode_flow(dx, dy)
    with pytest.raises(ValueError):
        rasters.decode_flow(rasters.encode_flow(dx * np.nan, dy))


def test_bayer_round_trip(spark):
    p = raster(spark, noise(4, 6, 50, 3)).select("t", "y", "x", F.col("c0").alias("v"))
    assert sorted(map(tuple, rasters.from_bayer(rasters.bayer_planes(p)).collect())) == sorted(map(tuple, p.collect()))


def test_params_round_trip(spark, tmp_path):
    row = [7, *[float(k) / 3 for k in range(14)], 12, 0.5]
    df = spark.createDataFrame([tuple(row)], ", ".join(f"`{c}` {'int' if c in ('label', 'count') else 'double'}" for c in rasters.PARAMS))
    rasters.write_params(df, str(tmp_path / "params"))
    assert list(rasters.read_params(spark, str(tmp_path / "params")).first()) == row


def test_stream_is_the_batch_however_frames_arrive(spark, tmp_path):
    from tessera.streaming.frames import carried, ordered

    rows = [(v, f, float((v * 7 + f * f) % 5)) for v in range(3) for f in range(12)]
    want = {(r.video, r.frame): r.change for r in ordered(spark.createDataFrame(rows, "video long, f long, value double"), "video", ["f"]).collect()}
    random.Random(4).shuffle(rows)
    schema = "video long, frame long, value double"
    for k in range(4):
        spark.createDataFrame(rows[k::4], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = carried(stream).writeStream.format("memory").queryName("frames_out").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("frames_out").where("not late").collect()
    assert {(r.video, r.frame): (None if r.change is None or r.change != r.change else r.change) for r in got} == want


def test_child_ids_are_new_and_distinct(spark):
    grid = noise(9, 11, 3, 8)
    sizes = components.component_sizes(components.components(raster(spark, grid)))
    rows = regions.child_ids(sizes).collect()
    assert len({r.spix_new for r in rows}) == len(rows)
    for label in {r.spix for r in rows}:
        mine = [r for r in rows if r.spix == label]
        kept = [r for r in mine if r.spix_new == label]
        assert len(kept) == 1 and kept[0].size == max(r.size for r in mine)
        assert all(r.spix_new > 2 for r in mine if r is not kept[0])


def plain_fill(grid, centres, w, h):
    while any(v < 0 for row in grid for v in row):
        for py, px in ((0, 0), (1, 0), (0, 1), (1, 1)):
            new = {}
            for y in range(py, h, 2):
                for x in range(px, w, 2):
                    around = [(i, grid[b][a]) for i, (b, a) in enumerate(((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1))) if 0 <= b < h and 0 <= a < w and grid[b][a] >= 0]
                    if grid[y][x] < 0 and around:
                        near = lambda c: ((x - centres[c][0]) / w) ** 2 + ((y - centres[c][1]) / h) ** 2  # noqa: B023, E731
                        new[y, x] = min(around, key=lambda o: (near(o[1]), o[0]))[1]
            for (y, x), v in new.items():
                grid[y][x] = v
    return grid


def plain_centres(grid):
    at = {}
    for y, row in enumerate(grid):
        for x, v in enumerate(row):
            if v >= 0:
                at.setdefault(v, []).append((x, y))
    return {k: (sum(a for a, _ in v) / len(v), sum(b for _, b in v) / len(v)) for k, v in at.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_propagation_moves_fills_invalidates_and_fills(spark, seed):
    r, h, w = random.Random(seed), 9, 12
    grid = [[(y // 3) * 4 + x // 3 + r.choice([0, 0, 0, 1]) for x in range(w)] for y in range(h)]
    flow = {v: (r.choice([-1, 0, 1]), r.choice([-1, 0, 1])) for v in range(20)}
    rows = [(0, y, x, 1, 2, 3, grid[y][x], *flow[grid[y][x]]) for y in range(h) for x in range(w)]
    p = spark.createDataFrame(rows, "t int, y int, x int, c0 int, c1 int, c2 int, spix int, dx int, dy int")
    size, moved = {}, [[-1] * w for _ in range(h)]
    for row in grid:
        for v in row:
            size[v] = size.get(v, 0) + 1
    for y in range(h):
        for x in range(w):
            v = grid[y][x]
            b, a = y + flow[v][1], x + flow[v][0]
            if 0 <= b < h and 0 <= a < w and (moved[b][a] < 0 or (size[v], v) < (size[moved[b][a]], moved[b][a])):
                moved[b][a] = v
    shifted = {v: sum(row.count(v) for row in moved) for v in size}
    now = plain_fill([list(row) for row in moved], plain_centres(moved), w, h)
    roots, part = flood(now), {}
    for y in range(h):
        for x in range(w):
            part[now[y][x], roots[y][x]] = part.get((now[y][x], roots[y][x]), 0) + 1
    best = {v: min((-n, root) for (u, root), n in part.items() if u == v)[1] for v, _ in part}
    cut = [[now[y][x] if best[now[y][x]] == roots[y][x] else -1 for x in range(w)] for y in range(h)]
    want = plain_fill([list(row) for row in cut], plain_centres(cut), w, h)
    got, per = components.propagated(p, w)
    assert {(q.y, q.x): q.spix for q in got.collect()} == {(y, x): want[y][x] for y in range(h) for x in range(w)}
    filled = plain_centres(want)
    for q in per.collect():
        n = sum(row.count(q.spix) for row in want)
        assert (q.n_filled, q.n_shifted) == (n, shifted[q.spix]) and abs(q.invalid_ratio - (n - shifted[q.spix]) / (n + 1e-8)) < 1e-12
    assert per.count() == len(filled)


def test_refinement_steers_the_number_of_regions(spark):
    """Frames with too many regions merge, with too few split; no pixel is lost and none is without a label."""
    many = [[(y // 2) * 8 + x // 2 for x in range(16)] for y in range(16)]
    few = [[x // 8 for x in range(16)] for y in range(16)]
    colour = lambda y, x: 10 if (x // 4 + y // 8 * 2) % 3 else 40
    rows = [(t, y, x, colour(y, x), 2, 3, g[y][x]) for t, g in enumerate((many, few)) for y in range(16) for x in range(16)]
    p = spark.createDataFrame(rows, "t int, y int, x int, c0 int, c1 int, c2 int, spix int")
    out = segment.refined(p, 12.0, 4, sigma2=1.0).collect()
    assert sorted((r.t, r.y, r.x) for r in out) == sorted(r[:3] for r in rows) and all(r.spix >= 0 for r in out)
    have = [len({r.spix for r in out if r.t == t}) for t in (0, 1)]
    assert have[0] < 64 and have[1] > 2


def test_merges_apply_to_free_targets_only(spark):
    p = raster(spark, [[1, 2, 3, 4]])
    won = spark.createDataFrame([(0, 1, 2), (0, 2, 3)], "t int, f int, k int")
    assert [r.spix for r in segment.merged(p, won).orderBy("x").collect()] == [1, 3, 3, 4]


def test_masks(spark):
    gray = spark.createDataFrame([(0, 0, 0, 127), (0, 0, 1, 128)], "t int, y int, x int, v int")
    assert [r.gt for r in rasters.binary_masks(gray).orderBy("x").collect()] == [0, 1]
    rows = [("b", 0, 0, 0, 1), ("a", 0, 0, 0, 1), ("a", 0, 0, 1, 9), ("b", 0, 0, 1, 0), ("a", 0, 0, 2, 0)]
    masks = spark.createDataFrame(rows, "object string, t int, y int, x int, on int")
    assert [r.gt for r in rasters.stacked_masks(masks).orderBy("x").collect()] == [2, 1, 0]


def geodesic(grid, seed):
    """Steps to every pixel of the seed's region."""
    h, w = len(grid), len(grid[0])
    dist, todo = {seed: 0}, [seed]
    for a, b in todo:
        for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
            if 0 <= c < h and 0 <= d < w and grid[c][d] == grid[a][b] and (c, d) not in dist:
                dist[c, d] = dist[a, b] + 1
                todo.append((c, d))
    return dist


@pytest.mark.parametrize("axis", ["x", "y"])
def test_growth_from_seeds_is_the_nearer_seed_inside_the_region(spark, axis):
    """Blocks, a winding corridor, broken regions and missing labels."""
    maze = [[1 if (y % 2 == 0) or x == (11 if y % 4 == 1 else 0) else 0 for x in range(12)] for y in range(9)]
    for grid in (noise(9, 12, 2, 3), maze, [[(y // 5) * 2 + x // 6 for x in range(12)] for y in range(9)], [[-1 if x == 3 else 7 for x in range(12)] for y in range(9)]):
        want = {}
        for v in {v for row in grid for v in row} - {-1}:
            at = [(y, x) for y in range(9) for x in range(12) if grid[y][x] == v]
            my, mx = sum(y for y, _ in at) // len(at), sum(x for _, x in at) // len(at)
            dy, dx = (0, 1) if axis == "x" else (2, 0)
            far = [geodesic(grid, s) if s in at else {} for s in ((my - dy, mx - dx), (my + dy, mx + dx))]
            for q in at:
                a, b = (f.get(q, 1000) for f in far)
                want[q] = None if a == b == 1000 else int(a > b)
        got = {(r.y, r.x): r.half for r in segment.grown(raster(spark, grid), axis).collect()}
        assert got == {(y, x): want.get((y, x)) for y in range(9) for x in range(12)}


def png(grid):
    """A PNG of red, green, blue bytes."""
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + bytes(v for pixel in row for v in pixel) for row in grid)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(grid[0]), len(grid), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_frames_from_images(spark, tmp_path):
    for t in (1, 2):
        (tmp_path / f"{t:05d}.png").write_bytes(png([[(t, x, y) for x in range(3)] for y in range(2)]))
    got = {(r.t, r.y, r.x): (round(r.c0 * 255), round(r.c1 * 255), round(r.c2 * 255)) for r in rasters.read_frames(spark, str(tmp_path), offset=1).collect()}
    assert got == {(t - 1, y, x): (t, x, y) for t in (1, 2) for y in range(2) for x in range(3)}


def test_summaries_cache_and_names(spark, tmp_path):
    for method, video, value in (("a", "v1", 0.5), ("a", "v2", 0.25), ("b", "v1", 1.0)):
        (tmp_path / "runs" / method / "sp4" / video).mkdir(parents=True)
        (tmp_path / "runs" / method / "sp4" / video / "summary.csv").write_text(f"metric,mean[0],std\nTEX,{value},0\n")
    rows = rasters.read_summaries(spark, str(tmp_path / "runs"))
    want = [("a", "sp4", "v1", "TEX", 0.5), ("a", "sp4", "v2", "TEX", 0.25), ("b", "sp4", "v1", "TEX", 1.0)]
    assert sorted(tuple(r) for r in rows.collect()) == want
    for _ in range(2):
        rasters.write_summary_cache(rows, str(tmp_path / "cache"))
    again = spark.read.parquet(str(tmp_path / "cache")).select("method", "param", "video", "metric", "mean")
    assert sorted(tuple(r) for r in again.collect()) == want
    (tmp_path / "names.txt").write_text("v1\n\n v2 \n")
    assert sorted(r.name for r in rasters.read_names(spark, str(tmp_path / "names.txt")).collect()) == ["v1", "v2"]
