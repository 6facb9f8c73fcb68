"""Named queries over the driver tables, and the SQL each agrees with."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.padding import max_boundary_spacing, resolve_padding
from gridloom.operators import assign, field, seeds as seed_ops, topology, voronoi
from gridloom.plans.pipeline import GridTriangulation, triangulate_frame
from gridloom.streaming.mesh import Delaunay, insert_batch

SIDE, PADDING = 64, 16
_PLACED = {
    "supplier": "SELECT (s_suppkey*37+s_nationkey*11) % {side} x, CAST(floor(abs(s_acctbal)) AS BIGINT) % {side} y, s_acctbal v FROM supplier",
}


def placed(spark: SparkSession, sf_dir: str, name: str = "supplier", side: int = SIDE) -> DataFrame:
    """(x, y, value) of every row of a table, places may repeat."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "supplier":
        x, balance = F.col("s_suppkey") * 37 + F.col("s_nationkey") * 11, F.col("s_acctbal")
    else:
        x, balance = F.col("c_custkey") * 7919, F.col("c_acctbal")
    y = F.floor(F.abs(balance)).cast("long")
    return df.select((x % side).cast("int").alias("x"), (y % side).cast("int").alias("y"), balance.alias("value"))


def ranked(spark: SparkSession, sf_dir: str, name: str = "supplier", side: int = SIDE) -> DataFrame:
    """Seeds (seed_id, x, y, value): of several rows in one place the largest value stays."""
    one = placed(spark, sf_dir, name, side).groupBy("x", "y").agg(F.max("value").alias("value"))
    return seed_ops.rank_seeds(one).persist()


def query_points(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("qid"), (F.col("o_custkey") % side).cast("int").alias("x"), (F.col("o_orderkey") % side).cast("int").alias("y"), (F.col("o_orderkey") % 7).cast("double").alias("t"))


class Scene:
    """Seeds, padded diagram and triangles of a table, each computed once."""

    def __init__(self, spark: SparkSession, sf_dir: str, padding: int = PADDING, name: str = "supplier", side: int = SIDE):
        self.side = side
        self.seeds = ranked(spark, sf_dir, name, side)
        self.padded = voronoi.voronoi(self.seeds, side, side, padding).persist()
        self.diagram = voronoi.crop(self.padded, side, side)
        self.triangles = topology.triangles(topology.witnesses(self.padded, self.seeds).persist()).persist()

    def grid(self) -> DataFrame:
        return assign.assign(self.diagram, self.triangles, self.seeds)


def seed_rank(spark, sf_dir):
    return ranked(spark, sf_dir).select("seed_id", "x", "y", "value")


def seed_duplicates(spark, sf_dir):
    return seed_ops.duplicate_seeds(placed(spark, sf_dir))


def seed_out_of_bounds(spark, sf_dir):
    return seed_ops.seeds_outside(placed(spark, sf_dir), SIDE // 2, SIDE // 2)


def sorted_rank(spark, sf_dir):
    """Insertion order is by value, the largest first."""
    by_value = ranked(spark, sf_dir).withColumn("bucket", -F.floor("value"))
    from gridloom.operators.ranking import with_rank

    return with_rank(by_value.withColumn("falling", -F.col("value")), F.col("bucket"), ("falling", "x", "y"), "ins_id").select("ins_id", "seed_id")


def voronoi_(spark, sf_dir):
    return voronoi.voronoi(ranked(spark, sf_dir), SIDE, SIDE)


def voronoi_padded(spark, sf_dir):
    return voronoi.voronoi(ranked(spark, sf_dir), SIDE, SIDE, PADDING, "compare")


def voronoi_transform(spark, sf_dir):
    return voronoi.voronoi(ranked(spark, sf_dir), SIDE, SIDE, PADDING, "transform")


def voronoi_cell_area(spark, sf_dir):
    return voronoi_(spark, sf_dir).groupBy("seed_id").agg(F.count(F.lit(1)).alias("area"), F.max("dist2").alias("max_dist2"))


def triangles(spark, sf_dir):
    return Scene(spark, sf_dir).triangles


def triangles_unpadded(spark, sf_dir):
    return Scene(spark, sf_dir, 0).triangles


def raw_witness_count(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return topology.witnesses(s.padded, s.seeds).groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n"))


def cocircular_quads(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return topology.cut_quads(topology.blocks(s.padded).where(F.size("ids") == 4), s.seeds).select("px", "py", "p", "q")


def seed_triangle_adjacency(spark, sf_dir):
    return topology.adjacency(Scene(spark, sf_dir).triangles)


def grid(spark, sf_dir):
    return Scene(spark, sf_dir).grid()


def grid_coverage(spark, sf_dir):
    return grid(spark, sf_dir).groupBy("triangle_id").agg(F.count(F.lit(1)).alias("n"))


def device_pixels(spark, sf_dir):
    return assign.device_pixels(grid(spark, sf_dir))


def edges(spark, sf_dir):
    return field.edges(Scene(spark, sf_dir).triangles)


def edge_scores(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return field.edge_scores(field.edges(s.triangles), s.seeds, 4.0).select("edge_idx", F.round(F.col("score").cast("double"), 6).alias("score"))


def select_midpoints(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return field.select_midpoints(field.edges(s.triangles), s.seeds, SIDE, SIDE, 4.0, 50, 10.0)


def locate(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return assign.locate(query_points(spark, sf_dir), s.triangles, s.seeds).select("qid", "triangle_id")


def in_circumsphere(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return assign.in_circumsphere(query_points(spark, sf_dir).withColumn("t", F.col("t") + 0.37), s.triangles, s.seeds)


def _in_batches(spark, sf_dir):
    """The seeds in five batches, by rank modulo five."""
    s = ranked(spark, sf_dir).withColumn("batch", F.col("seed_id") % 5)
    raster, dirty = None, None
    for k in range(5):
        raster, dirty = insert_batch(raster, s.where(F.col("batch") == k), SIDE, SIDE, PADDING)
    return s, raster


def incremental_voronoi(spark, sf_dir):
    return voronoi.crop(_in_batches(spark, sf_dir)[1], SIDE, SIDE)


def incremental_triangles(spark, sf_dir):
    s, raster = _in_batches(spark, sf_dir)
    return topology.triangles(topology.witnesses(raster.persist(), s).persist())


def _mesh(spark, sf_dir) -> Delaunay:
    """Even ranks first, then odd ones; within a batch seeds are inserted by (x, y)."""
    mesh = Delaunay(SIDE, SIDE, 1 << 20, PADDING, spark)
    s = ranked(spark, sf_dir)
    for k in (0, 1):
        mesh.insert_deferred(s.where(F.col("seed_id") % 2 == k).select("x", "y", "value"))
        if k == 0:
            mesh.finalise_device()
    return mesh


def mesh_grid(spark, sf_dir):
    return _mesh(spark, sf_dir).grid()


def mesh_triangles(spark, sf_dir):
    t = _mesh(spark, sf_dir).get_triangles()
    s = F.sort_array(F.array("a", "b", "c"))
    return t.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def mesh_edges(spark, sf_dir):
    return _mesh(spark, sf_dir).get_edges()


def _in_one(spark, sf_dir) -> Delaunay:
    """All seeds in one batch, so that insertion ids are ranks."""
    mesh = Delaunay(SIDE, SIDE, 1 << 20, PADDING, spark)
    mesh.insert_deferred(ranked(spark, sf_dir).select("x", "y", "value"))
    return mesh


def _halves(spark, sf_dir) -> tuple[Delaunay, list[DataFrame]]:
    s = ranked(spark, sf_dir)
    return Delaunay(SIDE, SIDE, 1 << 20, PADDING, spark), [s.where(F.col("seed_id") % 2 == k).select("x", "y") for k in (0, 1)]


def _pixels(spark, raster: np.ndarray, names: tuple[str, ...], first: int = 0) -> DataFrame:
    """(px, py, names) from an array of the image, as the array calls return it."""
    y, x = np.indices(raster.shape[:2])
    kinds = ", ".join(f"{n} {'long' if n == 'dist2' else 'int'}" for n in names)
    rows = np.column_stack([x.ravel() + first, y.ravel() + first, raster.reshape(-1, len(names))]).tolist()
    return spark.createDataFrame(rows, f"px int, py int, {kinds}")


def mesh_insert(spark, sf_dir):
    """One call an insertion; the dictionary of triangles after the second."""
    mesh, halves = _halves(spark, sf_dir)
    mesh.insert(halves[0])
    found, _ = mesh.insert(halves[1])
    return spark.createDataFrame([(k, *v) for k, v in found.items()], "triangle_id int, x int, y int, a int, b int, c int")


def mesh_insert_timed(spark, sf_dir):
    """The array of pixels after two timed insertions, the second one reopened from its folder."""
    mesh, halves = _halves(spark, sf_dir)
    mesh.insert_timed(halves[0])
    _, raster, _ = Delaunay.reopen(mesh.path, spark).insert_timed(halves[1], as_arrays=True)
    return _pixels(spark, raster, ("seed_id", "dist2", "triangle_id"))


def mesh_voronoi(spark, sf_dir):
    return _mesh(spark, sf_dir).get_voronoi_grid()


def mesh_seeds(spark, sf_dir):
    """The three getters of seeds, joined by insertion id."""
    mesh = _mesh(spark, sf_dir)
    values = mesh.get_values().select("ins_id", F.round(F.col("value").cast("double"), 6).alias("value"))
    return mesh.get_seeds().join(values, "ins_id").join(mesh.sorted_rank(), "ins_id")


def mesh_triangle_ids(spark, sf_dir):
    return _mesh(spark, sf_dir).get_triangles()


def mesh_properties(spark, sf_dir):
    m = _in_one(spark, sf_dir)
    row = (m.width, m.height, m.max_seeds, m.border_padding, m.seed_count, m.generation, m.has_pending)
    return spark.createDataFrame([row], "width int, height int, max_seeds int, border_padding int, seed_count long, generation int, has_pending boolean")


def mesh_locate(spark, sf_dir):
    return _in_one(spark, sf_dir).locate(query_points(spark, sf_dir))


def mesh_in_circumsphere(spark, sf_dir):
    return _in_one(spark, sf_dir).in_circumsphere(query_points(spark, sf_dir).withColumn("t", F.col("t") + 0.37))


def mesh_midpoints(spark, sf_dir):
    return _mesh(spark, sf_dir).select_midpoints(4.0, 50, 10.0)


def one_call_grid(spark, sf_dir):
    return triangulate_frame(spark, SIDE, SIDE, ranked(spark, sf_dir), PADDING).grid


def two_step_triangles(spark, sf_dir):
    """The array of triples from the timed two-step call."""
    found, _, _ = GridTriangulation(spark).compute_timed(np.zeros((SIDE, SIDE, 2)), ranked(spark, sf_dir), PADDING, as_arrays=True)
    return spark.createDataFrame([(i, *t) for i, t in enumerate(found.tolist())], "triangle_id int, a int, b int, c int")


def two_step_grid(spark, sf_dir):
    _, raster = GridTriangulation(spark).compute(np.zeros((SIDE, SIDE, 2)), ranked(spark, sf_dir), PADDING)
    return _pixels(spark, raster, ("seed_id", "dist2", "triangle_id"))


def two_step_padded(spark, sf_dir):
    """The padded diagram that the debugging call returns besides."""
    *_, padded = GridTriangulation(spark).compute_debug(np.zeros((SIDE, SIDE, 2)), ranked(spark, sf_dir), PADDING)
    return _pixels(spark, padded, ("seed_id", "dist2"), -PADDING)


def raw_witness_bound(spark, sf_dir):
    """Witnesses of the padded canvas, and the most there could be."""
    s, side = Scene(spark, sf_dir), SIDE + 2 * PADDING
    return topology.witnesses(s.padded, s.seeds).agg(F.count(F.lit(1)).alias("n"), F.lit(topology.raw_bound(side, side)).cast("long").alias("bound"))


def padding_resolved(spark, sf_dir):
    return spark.createDataFrame([(p, resolve_padding(p)) for p in [None, *range(-1, 40)]], "given int, resolved int")


def grid_summary(spark, sf_dir):
    """Share of pixels outside every triangle, and the largest distance to a seed."""
    none = F.sum((F.col("triangle_id") == assign.NO_TRIANGLE).cast("int"))
    return grid(spark, sf_dir).agg(F.round(none / F.count(F.lit(1)) * 100, 6).alias("outside_percent"), F.round(F.sqrt(F.max("dist2").cast("double")), 6).alias("max_distance"))


def padding_spacing(spark, sf_dir):
    return spark.createDataFrame([(p, max_boundary_spacing(p)) for p in range(65)], "p int, spacing int")


def _seed_sql(side: int = SIDE) -> str:
    return f"""p AS ({_PLACED["supplier"].format(side=side)}),
seeds AS (SELECT CAST(row_number() OVER (ORDER BY x, y) - 1 AS INT) AS seed_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, v AS value FROM (SELECT x, y, max(v) AS v FROM p GROUP BY x, y))"""


def _voronoi_sql(padding: int, side: int = SIDE) -> str:
    return f"""{_seed_sql(side)},
pix AS (SELECT CAST(a.range AS INT) AS px, CAST(b.range AS INT) AS py FROM range(-{padding}, {side} + {padding}) a, range(-{padding}, {side} + {padding}) b),
near AS (SELECT px, py, min({{'d': (CAST(px AS BIGINT) - x) * (px - x) + (CAST(py AS BIGINT) - y) * (py - y), 's': -seed_id}}) AS m FROM pix, seeds GROUP BY px, py),
vor AS (SELECT px, py, CAST(-m.s AS INT) AS seed_id, CAST(m.d AS BIGINT) AS dist2 FROM near)"""


def _triangle_sql(padding: int = PADDING, side: int = SIDE) -> str:
    d2 = lambda i, j: f"(CAST(o[{i}].x AS BIGINT) - o[{j}].x) * (o[{i}].x - o[{j}].x) + (CAST(o[{i}].y AS BIGINT) - o[{j}].y) * (o[{i}].y - o[{j}].y)"
    return f"""{_voronoi_sql(padding, side)},
blk AS (SELECT t.px, t.py, t.seed_id AS i1, r.seed_id AS i2, u.seed_id AS i3, v.seed_id AS i4 FROM vor t JOIN vor r ON r.px = t.px + 1 AND r.py = t.py
  JOIN vor u ON u.px = t.px AND u.py = t.py + 1 JOIN vor v ON v.px = t.px + 1 AND v.py = t.py + 1),
ids AS (SELECT px, py, i, min(pos) AS pos FROM (SELECT px, py, unnest([i1, i2, i3, i4]) AS i, unnest([1, 2, 3, 4]) AS pos FROM blk) GROUP BY px, py, i),
grp AS (SELECT px, py, list(i ORDER BY i) AS l, count(*) AS k FROM ids GROUP BY px, py HAVING count(*) >= 3),
cen AS (SELECT px, py, sum(x) AS sx, sum(y) AS sy, min(i) AS low FROM ids JOIN grp USING (px, py) JOIN seeds ON seed_id = i WHERE k = 4 GROUP BY px, py),
ring AS (SELECT px, py, low, list({{'i': i, 'x': x, 'y': y}} ORDER BY atan2(CAST(4 * y - sy AS DOUBLE), CAST(4 * x - sx AS DOUBLE)), pos) AS o FROM ids JOIN cen USING (px, py) JOIN seeds ON seed_id = i GROUP BY px, py, low),
diag AS (SELECT px, py, o, {d2(1, 3)} AS d0, {d2(2, 4)} AS d1, low FROM ring),
pick AS (SELECT px, py, o, d0 < d1 OR (d0 = d1 AND low <> o[1].i AND low <> o[3].i) AS first FROM diag),
cut AS (SELECT px, py, CASE WHEN first THEN least(o[1].i, o[3].i) ELSE least(o[2].i, o[4].i) END AS p, CASE WHEN first THEN greatest(o[1].i, o[3].i) ELSE greatest(o[2].i, o[4].i) END AS q,
  CASE WHEN first THEN [o[2].i, o[4].i] ELSE [o[1].i, o[3].i] END AS rest FROM pick),
raw AS (SELECT px, py, l FROM grp WHERE k = 3 UNION ALL SELECT px, py, list_sort([p, q, r]) AS l FROM (SELECT px, py, p, q, unnest(rest) AS r FROM cut)),
wit AS (SELECT px AS x, py AS y, l[1] AS a, l[2] AS b, l[3] AS c FROM raw),
uni AS (SELECT a, b, c, min({{'y': y, 'x': x}}) AS m FROM wit GROUP BY a, b, c),
tri AS (SELECT CAST(row_number() OVER (ORDER BY a, b, c) - 1 AS INT) AS triangle_id, m.x AS x, m.y AS y, a, b, c FROM uni),
cor AS (SELECT triangle_id, CAST(p.x AS BIGINT) AS ax, CAST(p.y AS BIGINT) AS ay, CAST(q.x AS BIGINT) AS bx, CAST(q.y AS BIGINT) AS by_, CAST(r.x AS BIGINT) AS cx, CAST(r.y AS BIGINT) AS cy
  FROM tri JOIN seeds p ON p.seed_id = a JOIN seeds q ON q.seed_id = b JOIN seeds r ON r.seed_id = c)"""


def _held_sql(points: str, keys: str, x: str, y: str) -> str:
    d1, d2, d3 = (f"(({b} - {a}) * ({y} - {e}) - ({f} - {e}) * ({x} - {a}))" for a, e, b, f in (("ax", "ay", "bx", "by_"), ("bx", "by_", "cx", "cy"), ("cx", "cy", "ax", "ay")))
    return f"""held AS (SELECT {keys}, max(triangle_id) AS triangle_id FROM {points} JOIN cor ON {x} BETWEEN least(ax, bx, cx) AND greatest(ax, bx, cx) AND {y} BETWEEN least(ay, by_, cy) AND greatest(ay, by_, cy)
  WHERE (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) <> 0 AND NOT (({d1} < 0 OR {d2} < 0 OR {d3} < 0) AND ({d1} > 0 OR {d2} > 0 OR {d3} > 0)) GROUP BY {keys})"""


_GRID_SQL = f"""{_triangle_sql()},
img AS (SELECT * FROM vor WHERE px >= 0 AND py >= 0 AND px < {SIDE} AND py < {SIDE}),
{_held_sql("img", "px, py", "px", "py")},
grd AS (SELECT px, py, seed_id, dist2, coalesce(triangle_id, -1) AS triangle_id FROM img LEFT JOIN held USING (px, py))"""
_EDGE_SQL = f"""{_triangle_sql()},
edg AS (SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INT) AS edge_idx, a, b FROM (SELECT a, b FROM tri UNION SELECT a, c FROM tri UNION SELECT b, c FROM tri)),
sco AS (SELECT edge_idx, a, b, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_,
  CASE WHEN (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) < 16 THEN CAST(0 AS FLOAT)
  ELSE CAST(abs(CAST(CAST(q.value AS FLOAT) AS DOUBLE) - CAST(CAST(p.value AS FLOAT) AS DOUBLE)) * sqrt(CAST((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) AS DOUBLE)) AS FLOAT) END AS score
  FROM edg JOIN seeds p ON p.seed_id = a JOIN seeds q ON q.seed_id = b)"""
_POINT_SQL = f"""{_triangle_sql()},
pts AS (SELECT o_orderkey AS qid, CAST(o_custkey % {SIDE} AS BIGINT) AS x, CAST(o_orderkey % {SIDE} AS BIGINT) AS y, CAST(o_orderkey % 7 AS DOUBLE) + 0.37 AS t FROM orders),
{_held_sql("pts", "qid", "x", "y")}"""
_SPHERE_SQL = f"""{_POINT_SQL},
geo AS (SELECT qid, x, y, t, triangle_id, CAST(ax AS DOUBLE) AS ax, CAST(ay AS DOUBLE) AS ay, CAST(bx AS DOUBLE) AS bx, CAST(by_ AS DOUBLE) AS by_, CAST(cx AS DOUBLE) AS cx, CAST(cy AS DOUBLE) AS cy,
  CAST(bx - ax AS DOUBLE) AS ux, CAST(by_ - ay AS DOUBLE) AS uy, CAST(cx - ax AS DOUBLE) AS vx, CAST(cy - ay AS DOUBLE) AS vy FROM pts JOIN held USING (qid) JOIN cor USING (triangle_id)),
ctr AS (SELECT *, ux * vy - uy * vx AS n, ux * ux + uy * uy AS u2, vx * vx + vy * vy AS v2 FROM geo),
mid AS (SELECT *, ax + (v2 * (-(n * uy)) + u2 * (vy * n)) / (2.0 * (n * n)) AS ox, ay + (v2 * (n * ux) + u2 * (-(vx * n))) / (2.0 * (n * n)) AS oy FROM ctr),
ans AS (SELECT qid, sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy) + t * t) < sqrt(greatest((ax - ox) * (ax - ox) + (ay - oy) * (ay - oy), (bx - ox) * (bx - ox) + (by_ - oy) * (by_ - oy), (cx - ox) * (cx - ox) + (cy - oy) * (cy - oy))) AS inside, triangle_id FROM mid)"""
_INSERTED_SQL = f"""{_triangle_sql()},
ins AS (SELECT seed_id, CAST(row_number() OVER (ORDER BY seed_id % 2, x, y) - 1 AS INT) AS ins_id FROM seeds)"""

SQL = {
    "seed_rank": f"WITH {_seed_sql()} SELECT seed_id, x, y, value FROM seeds",
    "seed_duplicates": f"WITH {_seed_sql()} SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, count(*) AS n FROM p GROUP BY x, y HAVING count(*) > 1",
    "seed_out_of_bounds": f"WITH {_seed_sql()} SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM p WHERE x >= {SIDE // 2} OR y >= {SIDE // 2} OR x < 0 OR y < 0",
    "sorted_rank": f"WITH {_seed_sql()} SELECT CAST(row_number() OVER (ORDER BY value DESC, x, y) - 1 AS INT) AS ins_id, seed_id FROM seeds",
    "voronoi": f"WITH {_voronoi_sql(0)} SELECT * FROM vor",
    "voronoi_padded": f"WITH {_voronoi_sql(PADDING)} SELECT * FROM vor",
    "voronoi_transform": f"WITH {_voronoi_sql(PADDING)} SELECT * FROM vor",
    "voronoi_cell_area": f"WITH {_voronoi_sql(0)} SELECT seed_id, count(*) AS area, max(dist2) AS max_dist2 FROM vor GROUP BY seed_id",
    "triangles": f"WITH {_triangle_sql()} SELECT triangle_id, x, y, a, b, c FROM tri",
    "triangles_unpadded": f"WITH {_triangle_sql(0)} SELECT triangle_id, x, y, a, b, c FROM tri",
    "raw_witness_count": f"WITH {_triangle_sql()} SELECT a, b, c, count(*) AS n FROM wit GROUP BY a, b, c",
    "cocircular_quads": f"WITH {_triangle_sql()} SELECT px, py, p, q FROM cut",
    "seed_triangle_adjacency": f"WITH {_triangle_sql()} SELECT unnest([a, b, c]) AS seed_id, triangle_id FROM tri",
    "grid": f"WITH {_GRID_SQL} SELECT * FROM grd",
    "grid_coverage": f"WITH {_GRID_SQL} SELECT triangle_id, count(*) AS n FROM grd GROUP BY triangle_id",
    "device_pixels": f"WITH {_GRID_SQL} SELECT px, py, CASE WHEN triangle_id = -1 THEN 0 ELSE triangle_id END AS pixel_tid, seed_id, triangle_id = -1 AS outside FROM grd",
    "edges": f"WITH {_EDGE_SQL} SELECT edge_idx, a, b FROM edg",
    "edge_scores": f"WITH {_EDGE_SQL} SELECT edge_idx, round(CAST(score AS DOUBLE), 6) AS score FROM sco",
    "select_midpoints": f"""WITH {_EDGE_SQL}, top AS (SELECT * FROM sco WHERE score > 10.0 ORDER BY score DESC, edge_idx LIMIT 50),
mid AS (SELECT DISTINCT CAST(round_even((ax + bx) / 2.0, 0) AS INT) AS x, CAST(round_even((ay + by_) / 2.0, 0) AS INT) AS y FROM top)
SELECT x, y FROM mid WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.x = mid.x AND s.y = mid.y)""",
    "locate": f"WITH {_POINT_SQL} SELECT qid, coalesce(triangle_id, -1) AS triangle_id FROM pts LEFT JOIN held USING (qid)",
    "in_circumsphere": f"WITH {_SPHERE_SQL} SELECT qid, coalesce(inside, FALSE) AS inside, coalesce(triangle_id, -1) AS triangle_id FROM pts LEFT JOIN ans USING (qid)",
    "incremental_voronoi": f"WITH {_voronoi_sql(0)} SELECT * FROM vor",
    "incremental_triangles": f"WITH {_triangle_sql()} SELECT triangle_id, x, y, a, b, c FROM tri",
    "mesh_grid": f"WITH {_GRID_SQL} SELECT * FROM grd",
    "mesh_triangles": f"WITH {_INSERTED_SQL} SELECT l[1] AS a, l[2] AS b, l[3] AS c FROM (SELECT list_sort([p.ins_id, q.ins_id, r.ins_id]) AS l FROM tri JOIN ins p ON p.seed_id = a JOIN ins q ON q.seed_id = b JOIN ins r ON r.seed_id = c)",
    "mesh_edges": f"""WITH {_INSERTED_SQL} SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INT) AS edge_idx, a, b FROM (SELECT least(p.ins_id, q.ins_id) AS a, greatest(p.ins_id, q.ins_id) AS b
FROM (SELECT a AS i, b AS j FROM tri UNION SELECT a, c FROM tri UNION SELECT b, c FROM tri) JOIN ins p ON p.seed_id = i JOIN ins q ON q.seed_id = j)""",
    "mesh_insert": f"WITH {_triangle_sql()} SELECT triangle_id, x, y, a, b, c FROM tri",
    "mesh_insert_timed": f"WITH {_GRID_SQL} SELECT * FROM grd",
    "mesh_voronoi": f"WITH {_INSERTED_SQL} SELECT px, py, ins_id AS seed_id, dist2 FROM vor JOIN ins USING (seed_id) WHERE px >= 0 AND py >= 0 AND px < {SIDE} AND py < {SIDE}",
    "mesh_seeds": f"WITH {_INSERTED_SQL} SELECT ins_id, x, y, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) AS value, seed_id FROM seeds JOIN ins USING (seed_id)",
    "mesh_triangle_ids": f"WITH {_INSERTED_SQL} SELECT triangle_id, p.ins_id AS a, q.ins_id AS b, r.ins_id AS c FROM tri JOIN ins p ON p.seed_id = a JOIN ins q ON q.seed_id = b JOIN ins r ON r.seed_id = c",
    "mesh_properties": f"WITH {_seed_sql()} SELECT {SIDE} AS width, {SIDE} AS height, {1 << 20} AS max_seeds, {PADDING} AS border_padding, count(*) AS seed_count, 1 AS generation, TRUE AS has_pending FROM seeds",
    "mesh_locate": f"WITH {_POINT_SQL} SELECT qid, coalesce(triangle_id, -1) AS triangle_id FROM pts LEFT JOIN held USING (qid)",
    "mesh_in_circumsphere": f"WITH {_SPHERE_SQL} SELECT qid, coalesce(inside, FALSE) AS inside, coalesce(triangle_id, -1) AS triangle_id FROM pts LEFT JOIN ans USING (qid)",
    "mesh_midpoints": f"""WITH {_INSERTED_SQL}, edg AS (SELECT least(p.ins_id, q.ins_id) AS a, greatest(p.ins_id, q.ins_id) AS b, p.seed_id AS i, q.seed_id AS j
  FROM (SELECT a AS i, b AS j FROM tri UNION SELECT a, c FROM tri UNION SELECT b, c FROM tri) JOIN ins p ON p.seed_id = i JOIN ins q ON q.seed_id = j),
sco AS (SELECT a, b, p.x + q.x AS x2, p.y + q.y AS y2, (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) AS d,
  CAST(abs(CAST(CAST(q.value AS FLOAT) AS DOUBLE) - CAST(CAST(p.value AS FLOAT) AS DOUBLE)) * sqrt(CAST((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) AS DOUBLE)) AS FLOAT) AS score
  FROM edg JOIN seeds p ON p.seed_id = i JOIN seeds q ON q.seed_id = j),
top AS (SELECT * FROM sco WHERE d >= 16 AND score > 10.0 ORDER BY score DESC, a, b LIMIT 50),
mid AS (SELECT DISTINCT CAST(round_even(x2 / 2.0, 0) AS INT) AS x, CAST(round_even(y2 / 2.0, 0) AS INT) AS y FROM top)
SELECT x, y FROM mid WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.x = mid.x AND s.y = mid.y)""",
    "one_call_grid": f"WITH {_GRID_SQL} SELECT * FROM grd",
    "two_step_triangles": f"WITH {_triangle_sql()} SELECT triangle_id, a, b, c FROM tri",
    "two_step_grid": f"WITH {_GRID_SQL} SELECT * FROM grd",
    "two_step_padded": f"WITH {_voronoi_sql(PADDING)} SELECT * FROM vor",
    "raw_witness_bound": f"WITH {_triangle_sql()} SELECT count(*) AS n, CAST(2 * ({SIDE} + 2 * {PADDING} - 1) * ({SIDE} + 2 * {PADDING} - 1) AS BIGINT) AS bound FROM wit",
    "padding_resolved": "SELECT CAST(p AS INT) AS given, CASE WHEN p IS NULL OR p = -1 THEN 16 ELSE CAST(p AS INT) END AS resolved FROM (SELECT range AS p FROM range(-1, 40) UNION ALL SELECT NULL)",
    "grid_summary": f"WITH {_GRID_SQL} SELECT round(sum(CASE WHEN triangle_id = -1 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) * 100, 6) AS outside_percent, round(sqrt(CAST(max(dist2) AS DOUBLE)), 6) AS max_distance FROM grd",
    "padding_spacing": "SELECT CAST(range AS INT) AS p, CAST(floor(sqrt(8 * range)) AS INT) AS spacing FROM range(65)",
}
_NAMED = {"voronoi": voronoi_}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _NAMED.get(name) or globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
