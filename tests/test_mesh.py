"""The incremental mesh equals the batch result, whatever the batches."""

import numpy as np
import pytest

from gridloom.plans.pipeline import triangulate
from gridloom.streaming.mesh import Delaunay, StaleView
from tests.test_plane import random_points


def test_batches_equal_one_batch(spark):
    points = random_points(11, 30, 40, 32)
    mesh = Delaunay(40, 32, 100, spark=spark)
    mesh.insert_deferred(points[:12])
    mesh.finalise()
    mesh.insert_deferred(points[12:13])
    mesh.insert_deferred(np.array(points[13:]))
    found, grid = mesh.finalise(as_arrays=True)
    want, want_grid = triangulate(40, 32, points, as_arrays=True, spark=spark)
    assert found.tolist() == want.tolist() and (grid == want_grid).all()
    assert mesh.seed_count == 30 and not mesh.has_pending and mesh.border_padding == 16
    rank = {r.ins_id: r.seed_id for r in mesh.sorted_rank().collect()}
    assert [rank[i] for i in range(30)] == [sorted(points).index(p) for p in points]
    live = {frozenset(rank[i] for i in (r.a, r.b, r.c)) for r in mesh.get_triangles().collect()}
    assert live == {frozenset(t) for t in want.tolist()}
    pairs = [(r.a, r.b) for r in sorted(mesh.get_edges().collect())]
    assert pairs == sorted(pairs) and all(a < b for a, b in pairs)


def test_rejected_batches_change_nothing(spark):
    mesh = Delaunay(20, 20, 4, spark=spark)
    mesh.insert_deferred([(1, 1), (10, 3)])
    for bad in ([(1, 1)], [(2, 2), (2, 2)], [(20, 0)], [(3, 3), (4, 4), (5, 5)]):
        with pytest.raises(ValueError):
            mesh.insert_deferred(bad)
    with pytest.raises(ValueError, match="values"):
        mesh.insert_deferred([(7, 7)], [1.0])
    mesh.insert_deferred([])
    assert mesh.seed_count == 2 and mesh.generation == 1
    for size in ((0, 5, 3), (5, -1, 3), (5, 5, 0)):
        with pytest.raises(ValueError):
            Delaunay(*size, spark=spark)


def test_field_and_views(spark):
    points = random_points(12, 12, 30, 30)
    mesh = Delaunay(30, 30, 50, spark=spark)
    timings = mesh.insert_deferred_timed(points, np.arange(12.0).tolist())
    assert timings["bfs_iters"] == 1 and {"bfs_ms", "detect_ms", "dedup_ms"} <= set(timings)
    assert [r.value for r in mesh.get_values().collect()] == list(range(12))
    assert [(r.x, r.y) for r in mesh.get_seeds().collect()] == points
    assert mesh.edge_scores().count() == mesh.get_edges().count()
    assert 0 < mesh.select_midpoints(2.0, 5).count() <= 5
    triangles, pixels = mesh.finalise_device()
    host = pixels.to_host()
    assert len(host) == 900 and (host.pixel_tid[host.outside] == 0).all()
    grid = mesh.finalise()[1]
    at = {r.qid: r.triangle_id for r in mesh.locate([(5, 5), (20, 12)]).collect()}
    assert at == {0: grid[5, 5, 2], 1: grid[12, 20, 2]}
    assert {r.qid for r in mesh.in_circumsphere([(5, 5)], [0.0]).collect()} == {0}
    mesh.insert_deferred([next(p for p in random_points(1, 50, 30, 30) if p not in points)], [1.0])
    with pytest.raises(StaleView):
        triangles.frame()


def test_stream_of_batches(spark, tmp_path):
    points = random_points(13, 9, 24, 24)
    mesh = Delaunay(24, 24, 50, spark=spark)
    for i in range(3):
        spark.createDataFrame(points[3 * i : 3 * i + 3], "x int, y int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x int, y int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(mesh.process).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "at")).start()
    query.awaitTermination()
    mesh.process(spark.createDataFrame(points[:3], "x int, y int"), 0)  # a replay
    assert mesh.seed_count == 9
    found, grid = mesh.finalise(as_arrays=True)
    want, want_grid = triangulate(24, 24, points, as_arrays=True, spark=spark)
    assert found.tolist() == want.tolist() and (grid == want_grid).all()


def test_a_mesh_goes_on_after_a_restart(spark, tmp_path):
    points = random_points(21, 24, 32, 32)
    path = str(tmp_path / "mesh")
    frame = lambda a, b: spark.createDataFrame(points[a:b], "x int, y int")
    first = Delaunay(32, 32, 50, spark=spark, path=path)
    first.process(frame(0, 10), 0)
    first.finalise()
    with pytest.raises(ValueError, match="reopen"):
        Delaunay(32, 32, 50, spark=spark, path=path)
    again = Delaunay.reopen(path, spark)
    again.process(frame(0, 10), 0)  # the stream sends its last batch again
    assert (again.seed_count, again.generation, again.has_pending) == (10, 1, False)
    again.process(frame(10, 17), 1)
    last = Delaunay.reopen(path, spark)
    assert (last.seed_count, last.has_pending) == (17, True)
    last.process(frame(10, 17), 1)
    last.process(frame(17, 24), 2)
    found, grid = last.finalise(as_arrays=True)
    want, want_grid = triangulate(32, 32, points, as_arrays=True, spark=spark)
    assert found.tolist() == want.tolist() and (grid == want_grid).all()
    assert (last.finalise(as_arrays=True)[1] == want_grid).all()  # once more changes nothing
    with pytest.raises(ValueError, match="no mesh"):
        Delaunay.reopen(str(tmp_path / "elsewhere"), spark)


def test_a_failed_write_changes_nothing(spark, monkeypatch):
    points = random_points(22, 14, 24, 24)
    mesh = Delaunay(24, 24, 50, spark=spark)
    mesh.insert_deferred(points[:8])
    store = Delaunay._store

    def broken(self, df, name, generation=None):
        if name == "triangles":
            raise OSError("no space")
        return store(self, df, name, generation)

    monkeypatch.setattr(Delaunay, "_store", broken)
    with pytest.raises(OSError):
        mesh.insert_deferred(points[8:])
    monkeypatch.undo()
    assert (mesh.seed_count, mesh.generation) == (8, 1)
    mesh.insert_deferred(points[8:])
    want, want_grid = triangulate(24, 24, points, as_arrays=True, spark=spark)
    assert (mesh.finalise(as_arrays=True)[1] == want_grid).all()


def test_calls_that_return_arrays(spark):
    points = random_points(23, 12, 20, 20)
    mesh = Delaunay(20, 20, 50, spark=spark)
    _, _, timing = mesh.insert_timed(points[:6])
    assert {"bfs_ms", "detect_ms", "dedup_ms", "assign_ms"} <= set(timing)
    found, grid = mesh.insert(points[6:], as_arrays=True)
    want, want_grid = triangulate(20, 20, points, as_arrays=True, spark=spark)
    assert found.tolist() == want.tolist() and (grid == want_grid).all()
    _, again, timing = mesh.finalise_timed()
    assert "assign_ms" in timing and (again == want_grid).all()
    diagram = {(r.px, r.py): (r.seed_id, r.dist2) for r in mesh.get_voronoi_grid().collect()}
    rank = {r.ins_id: r.seed_id for r in mesh.sorted_rank().collect()}
    assert all((rank[i], d) == tuple(grid[y, x, :2]) for (x, y), (i, d) in diagram.items()) and len(diagram) == 400
    assert mesh.locate([]).count() == 0
    with pytest.raises(ValueError):
        mesh.in_circumsphere([(1, 1), (2, 2)], [0.0, 1.0, 2.0])


def test_midpoints_go_back_into_the_mesh(spark):
    points = random_points(24, 12, 40, 40)
    value = lambda p: float(p[0] ** 2 + p[1])
    mesh = Delaunay(40, 40, 100, spark=spark)
    mesh.insert_deferred(points, [value(p) for p in points])
    for _ in range(2):
        more = [tuple(r) for r in mesh.select_midpoints(4.0, 6).collect()]
        before = mesh.seed_count
        mesh.insert_deferred(more, [value(p) for p in more])
        assert 0 < len(more) == mesh.seed_count - before
    pairs = [(r.edge_idx, r.a, r.b) for r in sorted(mesh.get_edges().collect())]
    assert [i for i, *_ in pairs] == list(range(len(pairs))) and mesh.edge_scores().count() == len(pairs)
