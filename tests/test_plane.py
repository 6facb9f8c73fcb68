"""Hand-computed fixtures, brute force and equivalences of the planar operators."""

from itertools import combinations

import numpy as np
import pytest

from gridloom.functions.padding import max_boundary_spacing, resolve_padding
from gridloom.operators import assign, field, seeds as seed_ops, topology, voronoi
from gridloom.plans.pipeline import GridTriangulation, Voronoi, triangulate, triangulate_frame
from gridloom.sources.seeds import seeds_from, to_raster


def brute_voronoi(width, height, points, padding=0):
    order = sorted(points)
    out = {}
    for y in range(-padding, height + padding):
        for x in range(-padding, width + padding):
            d, s = min(((x - a) ** 2 + (y - b) ** 2, -i) for i, (a, b) in enumerate(order))
            out[x, y] = (-s, d)
    return out


def brute_containing(points, triples, order):
    def side(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    out = {}
    for p in points:
        best = -1
        for tid, t in enumerate(triples):
            a, b, c = (order[i] for i in t)
            d = [side(a, b, p), side(b, c, p), side(c, a, p)]
            if side(a, b, c) and not (min(d) < 0 < max(d)):
                best = tid
        out[p] = best
    return out


def random_points(seed, n, width, height):
    rng = np.random.default_rng(seed)
    flat = rng.choice(width * height, n, replace=False)
    return [(int(v % width), int(v // width)) for v in flat]


def test_single_seed(spark):
    grid = Voronoi(spark).compute(5, 5, [(2, 2)])
    y, x = np.mgrid[:5, :5]
    assert (grid[..., 0] == 0).all() and (grid[..., 1] == (x - 2) ** 2 + (y - 2) ** 2).all()
    assert Voronoi(spark).compute(4, 4, [(0, 0)])[3, 3, 1] == 18


def test_ties_take_the_higher_id(spark):
    row = Voronoi(spark).compute(5, 1, [(0, 0), (4, 0)])[0]
    assert row[:, 0].tolist() == [0, 0, 1, 1, 1] and row[:, 1].tolist() == [0, 1, 4, 1, 0]
    assert Voronoi(spark).compute(1, 5, [(0, 0), (0, 4)])[2, 0, 0] == 1
    assert Voronoi(spark).compute(5, 5, [(0, 2), (2, 0), (4, 2)])[2, 2, 0] == 2


def test_ids_follow_x_then_y(spark):
    ranked = seed_ops.rank_seeds(seeds_from(spark, [(3, 0), (1, 0), (1, 4), (0, 9)])).select("seed_id", "x", "y").collect()
    assert sorted(map(tuple, ranked)) == [(0, 0, 9), (1, 1, 0), (2, 1, 4), (3, 3, 0)]


@pytest.mark.parametrize("strategy", ["compare", "transform"])
def test_voronoi_against_brute_force(spark, strategy):
    points = random_points(1, 23, 19, 13)
    got = voronoi.voronoi(seed_ops.rank_seeds(seeds_from(spark, points)), 19, 13, 4, strategy).collect()
    assert {(r.px, r.py): (r.seed_id, r.dist2) for r in got} == brute_voronoi(19, 13, points, 4)


def test_one_triangle(spark):
    found, grid = triangulate(10, 10, [(1, 1), (8, 1), (4, 8)], spark=spark)
    assert [sorted(t[2:]) for t in found.values()] == [[0, 1, 2]]
    assert (grid[..., 2] == -1).any() and (grid[..., 2] == 0).any()


@pytest.mark.parametrize(("size", "corners"), [(10, (1, 8)), (5, (0, 4)), (15, (2, 12))])
def test_square_is_cut_once(spark, size, corners):
    found, _ = triangulate(size, size, [(x, y) for x in corners for y in corners], as_arrays=True, spark=spark)
    assert len(found) == 2
    assert len(set(found[0]) & set(found[1])) == 2


def test_cut_does_not_turn_with_the_image(spark):
    a, _ = triangulate(13, 13, [(2, 3), (9, 3), (2, 10), (9, 10)], as_arrays=True, spark=spark)
    b, _ = triangulate(13, 13, [(12 - y, x) for x, y in [(2, 3), (9, 3), (2, 10), (9, 10)]], as_arrays=True, spark=spark)
    assert len(a) == len(b) == 2


def test_sparse_sets_are_delaunay(spark):
    """Every triangle has an empty circumcircle, up to the raster's resolution."""
    points = random_points(5, 12, 96, 96)
    found, _ = triangulate(96, 96, points, 64, as_arrays=True, spark=spark)
    order = sorted(points)
    for t in found:
        (ax, ay), (bx, by), (cx, cy) = (order[i] for i in t)
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        ox = ((ax * ax + ay * ay) * (by - cy) + (bx * bx + by * by) * (cy - ay) + (cx * cx + cy * cy) * (ay - by)) / d
        oy = ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by * by) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / d
        r = np.hypot(ax - ox, ay - oy)
        assert all(np.hypot(x - ox, y - oy) > r - 2 for x, y in order)


def test_pixels_get_the_highest_containing_triangle(spark):
    points = random_points(3, 15, 50, 50)
    found, grid = triangulate(50, 50, points, as_arrays=True, spark=spark)
    want = brute_containing([(x, y) for x in range(50) for y in range(50)], found.tolist(), sorted(points))
    assert all(grid[y, x, 2] == tid for (x, y), tid in want.items())


def test_two_steps_equal_one_call(spark):
    points = random_points(4, 20, 30, 24)
    diagram = Voronoi(spark).compute(30, 24, points)
    one, two = triangulate(30, 24, points, spark=spark), GridTriangulation(spark).compute(diagram, points)
    assert one[0] == two[0] and (one[1] == two[1]).all() and (two[1][..., :2] == diagram).all()
    *_, timings = GridTriangulation(spark).compute_timed(diagram, points)
    assert {"detect_ms", "dedup_ms", "assign_ms"} <= set(timings)
    *_, padded = GridTriangulation(spark).compute_debug(diagram, points, 8)
    assert padded.shape == (40, 46, 2) and (padded[8:32, 8:38] == diagram).all()


def test_padding():
    assert resolve_padding(None) == resolve_padding(-1) == 16 and resolve_padding(0) == 0 and resolve_padding(7) == 7
    with pytest.raises(ValueError, match="border_padding"):
        resolve_padding(-5)
    assert [max_boundary_spacing(p) for p in (-1, 0, 2, 8, 16, 32)] == [0, 0, 4, 8, 11, 16]
    assert topology.raw_bound(5, 4) == 24


@pytest.mark.parametrize(("width", "height", "points"), [(5, 5, []), (5, 5, [(1, 1), (1, 1)]), (5, 5, [(5, 0)]), (5, 5, [(0, -1)]), (0, 5, [(0, 0)]), (5, -1, [(0, 0)])])
def test_bad_seeds(spark, width, height, points):
    with pytest.raises(ValueError):
        triangulate_frame(spark, width, height, points)


def test_field(spark):
    points = random_points(6, 25, 40, 32)
    values = np.random.default_rng(7).normal(size=25)
    ranked = seed_ops.rank_seeds(seeds_from(spark, points, values.tolist())).persist()
    found = topology.triangles(topology.witnesses(voronoi.voronoi(ranked, 40, 32, 16), ranked)).persist()
    at = {r.seed_id: r for r in ranked.collect()}
    edge_rows = sorted(field.edges(found).collect())
    want = sorted({tuple(sorted(p)) for r in found.collect() for p in combinations((r.a, r.b, r.c), 2)})
    assert [(r.a, r.b) for r in edge_rows] == want and [r.edge_idx for r in edge_rows] == list(range(len(want)))
    single = lambda v: float(np.float32(v))
    score = {
        i: 0.0 if (d := (at[a].x - at[b].x) ** 2 + (at[a].y - at[b].y) ** 2) < 25 else abs(single(at[a].value) - single(at[b].value)) * d**0.5 for i, (a, b) in enumerate(want)
    }
    for r in field.edge_scores(field.edges(found), ranked, 5.0).collect():
        assert r.score == np.float32(score[r.edge_idx])
    best = sorted((i for i in score if score[i] > 1.0), key=lambda i: (-single(score[i]), i))[:10]
    mids = {(round((at[want[i][0]].x + at[want[i][1]].x) / 2), round((at[want[i][0]].y + at[want[i][1]].y) / 2)) for i in best} - set(points)
    got = [tuple(r) for r in field.select_midpoints(field.edges(found), ranked, 40, 32, 5.0, 10, 1.0).collect()]
    assert got == sorted(mids, key=lambda p: (p[1], p[0]))


def test_scores_that_are_equal_in_single_precision_go_to_the_lower_edge(spark):
    """The second edge scores higher by a part in 10**10 only."""
    rows = [(0, 0, 0, 0.0), (1, 0, 10, 100.0), (2, 20, 0, 0.0), (3, 20, 10, 100.00000001)]
    seeds = spark.createDataFrame(rows, "seed_id int, x int, y int, value double")
    pairs = spark.createDataFrame([(0, 0, 1), (1, 2, 3)], "edge_idx int, a int, b int")
    scores = {r.edge_idx: r.score for r in field.edge_scores(pairs, seeds).collect()}
    assert scores[0] == scores[1] == 1000.0
    assert [tuple(r) for r in field.select_midpoints(pairs, seeds, 40, 40, 1.0, 1).collect()] == [(0, 5)]
    assert field.select_midpoints(pairs, seeds, 40, 40, 1.0, 2, 1000.0).count() == 0  # not above the threshold


def test_many_seeds_are_not_broadcast(spark):
    seeds = spark.range(voronoi.MAX_BROADCAST_SEEDS + 1).selectExpr("CAST(id AS INT) AS seed_id", "CAST(id % 200 AS INT) AS x", "CAST(id DIV 200 AS INT) AS y")
    with pytest.raises(ValueError, match="broadcast"):
        voronoi.voronoi(seeds, 200, 200, strategy="compare")


def test_locate_and_circumsphere(spark):
    points = random_points(8, 14, 40, 40)
    t = triangulate_frame(spark, 40, 40, points)
    grid, order, triples = t.raster(), sorted(points), t.triangle_array().tolist()
    asked = [(i, x, y) for i, (x, y) in enumerate(random_points(9, 60, 40, 40) + [(-3, 5), (44, 44)])]
    frame = spark.createDataFrame([(i, x, y, 0.0) for i, x, y in asked], "qid long, x int, y int, t double")
    want = brute_containing([(x, y) for _, x, y in asked], triples, order)
    got = {r.qid: r.triangle_id for r in assign.locate(frame, t.triangles, t.seeds).collect()}
    assert got == {i: want[x, y] for i, x, y in asked}
    assert all(got[i] == grid[y, x, 2] for i, x, y in asked if 0 <= x < 40 and 0 <= y < 40)
    near = {r.qid: r.inside for r in assign.in_circumsphere(frame, t.triangles, t.seeds).collect()}
    far = {r.qid: r.inside for r in assign.in_circumsphere(frame.selectExpr("qid", "x", "y", "200.0D AS t"), t.triangles, t.seeds).collect()}
    assert not any(far.values()) and any(near.values())
    assert not any(near[i] for i in near if got[i] == -1)


def test_rasters_and_sources(spark):
    with pytest.raises(ValueError, match="array"):
        seeds_from(spark, np.zeros((3, 3), int))
    with pytest.raises(ValueError, match="length"):
        seeds_from(spark, [(0, 0)], [1.0, 2.0])
    frame = spark.createDataFrame([(0, 1, 7), (1, 0, 8)], "px int, py int, v int")
    assert to_raster(frame, 2, 2, "v")[..., 0].tolist() == [[0, 8], [7, 0]]


def test_transform_across_strips_and_bands(spark):
    rng = np.random.default_rng(5)
    width, height, padding = 150, 140, 3
    places = np.unique(rng.integers(0, (width, height), (40, 2)), axis=0)
    seeds = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(places)], "seed_id int, x int, y int")
    got = voronoi.voronoi(seeds, width, height, padding, "transform").toPandas()
    d = (got.px.to_numpy()[:, None] - places[:, 0]) ** 2 + (got.py.to_numpy()[:, None] - places[:, 1]) ** 2
    best = d.min(axis=1)
    last = len(places) - 1 - (d == best[:, None])[:, ::-1].argmax(axis=1)  # ties to the higher id
    assert len(got) == len(got[["px", "py"]].drop_duplicates()) == (width + 2 * padding) * (height + 2 * padding)
    assert (got.dist2 == best).all() and (got.seed_id == last).all()


def test_blocks_across_tiles_and_holes(spark, monkeypatch):
    monkeypatch.setattr(topology, "SCAN_TILE", 4)
    rng = np.random.default_rng(6)
    ids = {(x, y): int(rng.integers(0, 6)) for x in range(-5, 9) for y in range(-3, 10) if rng.random() > 0.05}
    raster = spark.createDataFrame([(x, y, s) for (x, y), s in ids.items()], "px int, py int, seed_id int")
    want = set()
    for x, y in ids:
        four = [ids.get(p) for p in ((x, y), (x + 1, y), (x, y + 1), (x + 1, y + 1))]
        if None not in four and len(set(four)) >= 3:
            want.add((x, y, tuple(dict.fromkeys(four))))
    got = [(r.px, r.py, tuple(r.ids)) for r in topology.blocks(raster).collect()]
    assert len(got) == len(want) and set(got) == want


def test_filled_triangles_are_all_pixels_inside_or_on_the_border(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(assign, "FILL", 50)  # so that triangles and rows are laid out in parts
    rng = np.random.default_rng(7)
    corners = np.concatenate([rng.integers(0, 30, (60, 6)), [[0, 0, 29, 1, 29, 0], [0, 0, 29, 29, 28, 29], [3, 0, 3, 29, 4, 15]]])
    turn = lambda ax, ay, bx, by, cx, cy: (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    corners = corners[[turn(*t) != 0 for t in corners]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(corners)), pa.int32()), *(pa.array(c, pa.int32()) for c in corners.T)], ["triangle_id", *assign.CORNERS])
    got = [(r["px"], r["py"], r["triangle_id"]) for part in assign._fill([batch]) for r in part.to_pylist()]
    want = set()
    for i, (ax, ay, bx, by, cx, cy) in enumerate(corners.tolist()):
        for x in range(30):
            for y in range(30):
                sides = [turn(ax, ay, bx, by, x, y), turn(bx, by, cx, cy, x, y), turn(cx, cy, ax, ay, x, y)]
                if min(sides) >= 0 or max(sides) <= 0:
                    want.add((x, y, i))
    assert len(got) == len(want) and set(got) == want
