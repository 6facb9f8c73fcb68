"""An incremental triangulation: seeds arrive in batches, state lives in versioned tables.

Seeds carry an order key, x * height + y, in place of their rank. Keys sort as ranks do and never change when seeds
are added, so diagrams, witnesses and assignments of earlier versions stay valid; ranks are joined in when
results are read. A batch gets a diagram of its own seeds, which is merged into the one there is; blocks are looked at
again where a pixel changed its seed, and pixels are assigned again in the tiles of triangles that came or went, or
all of them where that is most of the image. The result equals the batch result over all seeds.

Every change is written first and then committed by one small file, which names the version's tables, its counts and
the last batch of a stream. ``reopen`` goes on from the last commit, so a driver that starts again neither loses a batch
nor inserts one twice, and a failed insertion leaves the mesh as it was.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.padding import resolve_padding
from gridloom.operators import assign, field, topology, voronoi
from gridloom.operators.ranking import with_rank
from gridloom.operators.seeds import check_size, duplicate_seeds
from gridloom.sources.seeds import seeds_from, to_array, to_map, to_raster


def insert_batch(raster: DataFrame | None, new: DataFrame, width: int, height: int, padding: int, strategy: str = "auto") -> tuple[DataFrame, DataFrame]:
    """The updated raster, and the pixels (px, py) whose nearest seed is another one now. No iteration."""
    fresh = voronoi.voronoi(new, width, height, padding, strategy)
    if raster is None:
        return fresh, fresh.select("px", "py")
    after = voronoi.nearest_of_both(raster, fresh)
    was = raster.select("px", "py", F.col("seed_id").alias("was"))
    return after, after.join(was, ["px", "py"], "left").where(~F.col("was").eqNullSafe(F.col("seed_id"))).select("px", "py")


def dirty_blocks(changed: DataFrame) -> DataFrame:
    """(x, y): top left of every 2 x 2 block that has a changed pixel."""
    shift = F.explode(F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (0, 1) for j in (0, 1)))).alias("d")
    return changed.select("px", "py", shift).select((F.col("px") - F.col("d.dx")).alias("x"), (F.col("py") - F.col("d.dy")).alias("y")).distinct()


def update_witnesses(old: DataFrame, raster: DataFrame, changed: DataFrame, seeds: DataFrame) -> DataFrame:
    """Witnesses of dirty blocks detected again; all others are kept."""
    dirty = dirty_blocks(changed)
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (0, 1) for j in (0, 1)))).alias("d")
    around = dirty.select("x", "y", near).select((F.col("x") + F.col("d.dx")).alias("px"), (F.col("y") + F.col("d.dy")).alias("py")).distinct()
    again = topology.witnesses(raster.join(around, ["px", "py"], "left_semi"), seeds).join(dirty, ["x", "y"], "left_semi")
    return old.join(dirty, ["x", "y"], "left_anti").select(*old.columns).unionByName(again)


class StaleView(RuntimeError):
    pass


class DeviceView:
    """A lazy frame tied to a version of the mesh; reading it after a change raises."""

    def __init__(self, mesh: Delaunay, frame: DataFrame):
        self._mesh, self._frame, self.generation = mesh, frame, mesh.generation

    def frame(self) -> DataFrame:
        if self.generation != self._mesh.generation:
            raise StaleView("the mesh has changed since this view was taken")
        return self._frame

    def to_host(self):
        return self.frame().toPandas()


#: From this share of dirty tiles on, all pixels are assigned again.
FULL_SHARE = 0.6


class Delaunay:
    """Append-only mesh over a fixed image. State is a set of Parquet tables under ``path``, one folder a version.

    Without ``path`` the state goes to a new folder, in the shared one or, on one machine, a temporary one.
    """

    def __init__(self, width: int, height: int, max_seeds: int, border_padding: int | None = -1, spark: SparkSession | None = None, path: str | None = None):
        check_size(width, height)
        if max_seeds <= 0:
            raise ValueError("max_seeds must be positive")
        self.spark = spark or SparkSession.getActiveSession()
        self.width, self.height, self.max_seeds = width, height, max_seeds
        self.border_padding = resolve_padding(border_padding)
        if path is None:
            shared = self.spark.conf.get("spark.checkpoint.dir", None)
            if not shared:
                if not self.spark.sparkContext.master.startswith("local"):
                    raise ValueError("give a path, or set spark.checkpoint.dir, to a folder that all executors share")
                shared = tempfile.mkdtemp(prefix="mesh-")
            path = f"{shared.rstrip('/')}/mesh-{uuid.uuid4().hex}"
        elif self._commits_at(self.spark, path):
            raise ValueError(f"there is a mesh in {path}; use reopen")
        self.path = path.rstrip("/")
        self.generation = 0
        self.seed_count = 0
        self.has_pending = False
        self.timings: dict[str, float] = {}
        self._valued: bool | None = None
        self._last_batch = -1
        self._commits = 0
        self._at: dict[str, str] = {}
        self._seeds = self._raster = self._witnesses = self._triangles = self._assigned = self._final_triangles = None

    # state

    @staticmethod
    def _commits_at(spark: SparkSession, path: str) -> list[dict]:
        try:
            return [json.loads(r[0]) for r in spark.read.text(f"{path.rstrip('/')}/commits/*").collect()]
        except AnalysisException:  # no such folder
            return []

    @classmethod
    def reopen(cls, path: str, spark: SparkSession | None = None) -> Delaunay:
        """The mesh as the last commit under ``path`` left it."""
        spark = spark or SparkSession.getActiveSession()
        found = cls._commits_at(spark, path)
        if not found:
            raise ValueError(f"there is no mesh in {path}")
        last = max(found, key=lambda c: c["commit"])
        self = cls(last["width"], last["height"], last["max_seeds"], last["border_padding"], spark)
        self.path, self._commits, self._at = path.rstrip("/"), last["commit"], last["tables"]
        self.generation, self.seed_count, self.has_pending = last["generation"], last["seed_count"], last["has_pending"]
        self._valued, self._last_batch = last["valued"], last["last_batch"]
        for name, at in self._at.items():
            setattr(self, f"_{name}", spark.read.parquet(f"{self.path}/{at}"))
        return self

    def _store(self, df: DataFrame, name: str, generation: int | None = None) -> DataFrame:
        at = f"{self.path}/{self.generation if generation is None else generation}/{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def _commit(self, tables: dict[str, str], **changes) -> None:
        """One file that names the new state; this object takes it on when the file is there."""
        at = self._at | tables
        state = {"generation": self.generation, "seed_count": self.seed_count, "has_pending": self.has_pending, "valued": self._valued, "last_batch": self._last_batch} | changes
        fixed = {"width": self.width, "height": self.height, "max_seeds": self.max_seeds, "border_padding": self.border_padding}
        line = json.dumps(fixed | state | {"commit": self._commits + 1, "tables": at})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/commits/{self._commits + 1}")
        self._commits, self._at = self._commits + 1, at
        self.generation, self.seed_count, self.has_pending = state["generation"], state["seed_count"], state["has_pending"]
        self._valued, self._last_batch = state["valued"], state["last_batch"]

    def _parse(self, seeds, values) -> DataFrame:
        batch = seeds_from(self.spark, seeds, values, self.seed_count)
        if isinstance(seeds, DataFrame):
            batch = with_rank(batch, F.col("x"), ("x", "y"), "rank").withColumn("ins_id", F.coalesce("ins_id", F.col("rank") + self.seed_count)).drop("rank")
        return batch.withColumn("seed_id", F.col("x").cast("long") * self.height + F.col("y")).select("seed_id", "ins_id", "x", "y", "value")

    def _validate(self, batch: DataFrame) -> tuple[int, bool]:
        """Number of seeds of the batch and whether they have values; raises before anything has changed."""
        n, valued, x0, x1, y0, y1 = batch.agg(F.count(F.lit(1)), F.count("value"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        if not n:
            return 0, False
        if self.seed_count + n > self.max_seeds:
            raise ValueError(f"{self.seed_count} + {n} seeds exceed max_seeds = {self.max_seeds}")
        if x0 < 0 or y0 < 0 or x1 >= self.width or y1 >= self.height:
            raise ValueError(f"seeds outside {self.width} x {self.height}")
        if valued not in (0, n):
            raise ValueError("either every seed of a batch has a value or none has")
        if duplicate_seeds(batch).first() is not None:
            raise ValueError("duplicate seed within the batch")
        if self._seeds is not None and batch.join(self._seeds.select("seed_id"), "seed_id", "left_semi").first() is not None:
            raise ValueError("a seed of the batch is there already")
        if self._valued is not None and self._valued != bool(valued):
            raise ValueError("either every batch carries values or none does")
        return n, bool(valued)

    # insertion

    def insert_deferred(self, seeds, values=None, batch_id: int | None = None) -> None:
        """Append seeds and update the diagram and the triangles; pixels are assigned by ``finalise``. Empty batches do nothing."""
        batch = self._parse(seeds, values)
        n, valued = self._validate(batch)
        if not n:
            return
        new = self.generation + 1
        began = time.perf_counter()
        batch = self._store(batch, "batch", new)
        raster, changed = insert_batch(self._raster, batch, self.width, self.height, self.border_padding)
        everyone = batch if self._seeds is None else self._store(self._seeds.unionByName(batch), "seeds", new)
        changed = self._store(changed, "changed", new)
        raster = self._store(raster, "raster", new)
        timings = {"bfs_ms": (time.perf_counter() - began) * 1e3, "bfs_iters": 1}
        began = time.perf_counter()
        found = topology.witnesses(raster, everyone) if self._witnesses is None else update_witnesses(self._witnesses, raster, changed, everyone)
        witnesses = self._store(found, "witnesses", new)
        timings["detect_ms"] = (time.perf_counter() - began) * 1e3
        began = time.perf_counter()
        one = with_rank(topology.first_witness(witnesses), F.expr(f"a div {topology.RANK_BUCKET}"), ("a", "b", "c"), "triangle_id")
        triangles = self._store(one.select("triangle_id", "x", "y", "a", "b", "c"), "triangles", new)
        timings["dedup_ms"] = (time.perf_counter() - began) * 1e3
        names = {"seeds": "batch" if self._seeds is None else "seeds", "raster": "raster", "witnesses": "witnesses", "triangles": "triangles"}
        last = self._last_batch if batch_id is None else batch_id
        self._commit({k: f"{new}/{v}" for k, v in names.items()}, generation=new, seed_count=self.seed_count + n, has_pending=True, valued=valued, last_batch=last)
        self._seeds, self._raster, self._witnesses, self._triangles, self.timings = everyone, raster, witnesses, triangles, timings

    def insert_deferred_timed(self, seeds, values=None) -> dict[str, float]:
        self.insert_deferred(seeds, values)
        return dict(self.timings)

    def insert(self, seeds, as_arrays: bool = False):
        self.insert_deferred(seeds)
        return self.finalise(as_arrays)

    def insert_timed(self, seeds, as_arrays: bool = False):
        self.insert_deferred(seeds)
        held = dict(self.timings)
        out = self.finalise_timed(as_arrays)
        return out[0], out[1], held | out[2]

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """For ``writeStream.foreachBatch``, whose ids rise: a batch that comes again is skipped, also after ``reopen``."""
        if batch_id > self._last_batch:
            self.insert_deferred(batch, batch_id=batch_id)

    # assignment

    def _assign(self) -> None:
        """(px, py, a, b, c) of covered pixels; after the first time only tiles of triangles that came or went, unless these are most."""
        now = topology.with_corners(self._triangles.select("triangle_id", "a", "b", "c"), self._seeds)
        pixels = voronoi.crop(self._raster, self.width, self.height).select("px", "py")
        key, run, mine = ["a", "b", "c"], uuid.uuid4().hex[:8], self.generation
        todo, keep = pixels, None
        if self._assigned is not None:
            before = self._final_triangles
            gone, come = before.join(now.select(*key), key, "left_anti"), now.join(before.select(*key), key, "left_anti")
            dirty = self._store(assign.tiled(gone.unionByName(come, allowMissingColumns=True)).select("tx", "ty").distinct(), f"dirty-{run}")
            tiles = -(-self.width // assign.TILE) * -(-self.height // assign.TILE)
            if dirty.count() < FULL_SHARE * tiles:
                bins = pixels.withColumns({"tx": F.floor(F.col("px") / assign.TILE).cast("int"), "ty": F.floor(F.col("py") / assign.TILE).cast("int")})
                todo = bins.join(dirty, ["tx", "ty"], "left_semi").select("px", "py")
                keep = self._assigned.join(todo, ["px", "py"], "left_anti")
        held = assign.containing(todo, self._triangles, self._seeds, ("px", "py"))
        held = held.join(self._triangles.select("triangle_id", *key), "triangle_id").select("px", "py", *key)
        assigned = self._store(held if keep is None else keep.unionByName(held), f"assigned-{run}")
        final = self._store(now, f"final-triangles-{run}")
        self._commit({"assigned": f"{mine}/assigned-{run}", "final_triangles": f"{mine}/final-triangles-{run}"}, has_pending=False)
        self._assigned, self._final_triangles = assigned, final

    def _ready(self) -> None:
        if self._seeds is None:
            raise RuntimeError("no seeds yet")

    def _flush(self) -> None:
        self._ready()
        if self.has_pending:
            self._assign()

    def _ranked(self) -> DataFrame:
        return with_rank(self._seeds.withColumnRenamed("seed_id", "key"), F.col("x"), ("x", "y"), "seed_id")

    def _named(self, triangles: DataFrame, by: str) -> DataFrame:
        """Order keys replaced by another id of the seeds."""
        for name in "abc":
            own = self._ranked().select(F.col("key").alias(name), F.col(by).alias(f"_{name}"))
            triangles = triangles.join(own, name)
        return triangles.select("triangle_id", "x", "y", *(F.col(f"_{n}").alias(n) for n in "abc"))

    def triangles(self) -> DataFrame:
        """(triangle_id, x, y, a, b, c) by rank."""
        self._ready()
        return self._named(self._triangles, "seed_id")

    def grid(self) -> DataFrame:
        """(px, py, seed_id, dist2, triangle_id); assigns what is pending."""
        self._flush()
        ids = self._assigned.join(self._triangles.select("triangle_id", "a", "b", "c"), ["a", "b", "c"]).select("px", "py", "triangle_id")
        seen = voronoi.crop(self._raster, self.width, self.height).withColumnRenamed("seed_id", "key").join(self._ranked().select("key", "seed_id"), "key")
        return seen.join(ids, ["px", "py"], "left").select("px", "py", "seed_id", "dist2", F.coalesce("triangle_id", F.lit(assign.NO_TRIANGLE)).alias("triangle_id"))

    def finalise(self, as_arrays: bool = False):
        self._flush()
        found = self.triangles()
        return (to_array(found) if as_arrays else to_map(found)), to_raster(self.grid(), self.width, self.height, "seed_id", "dist2", "triangle_id")

    def finalise_timed(self, as_arrays: bool = False):
        began = time.perf_counter()
        self._flush()
        timing = {"assign_ms": (time.perf_counter() - began) * 1e3}
        return *self.finalise(as_arrays), timing

    def finalise_device(self) -> tuple[DeviceView, DeviceView]:
        """Views of (triangle_id, a, b, c) and of (px, py, pixel_tid, seed_id, outside)."""
        self._flush()
        return DeviceView(self, self.triangles().select("triangle_id", "a", "b", "c")), DeviceView(self, assign.device_pixels(self.grid()))

    # reads without a raster

    def get_triangles(self) -> DataFrame:
        """(triangle_id, a, b, c) with insertion ids."""
        self._ready()
        return self._named(self._triangles, "ins_id").select("triangle_id", "a", "b", "c")

    def _by_insertion(self) -> DataFrame:
        return self._seeds.select(F.col("ins_id").alias("seed_id"), "x", "y", "value")

    def get_edges(self) -> DataFrame:
        """(edge_idx, a, b) with insertion ids, a < b."""
        t = self.get_triangles()
        s = F.sort_array(F.array("a", "b", "c"))
        return field.edges(t.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c")))

    def _values(self) -> DataFrame:
        if not self._valued:
            raise RuntimeError("the seeds have no values")
        return self._by_insertion()

    def edge_scores(self, min_length: float = 0.0) -> DataFrame:
        """(edge_idx, score)."""
        return field.edge_scores(self.get_edges(), self._values(), min_length).select("edge_idx", F.col("score").cast("float").alias("score"))

    def select_midpoints(self, min_length: float, count: int, threshold: float = 0.0) -> DataFrame:
        return field.select_midpoints(self.get_edges(), self._values(), self.width, self.height, min_length, count, threshold)

    def _points(self, points, t=None) -> DataFrame:
        if isinstance(points, DataFrame):
            return points
        rows = [tuple(int(v) for v in p) for p in points]
        times = [0.0] * len(rows) if t is None else np.broadcast_to(np.asarray(t, float), (len(rows),)).tolist()
        return self.spark.createDataFrame([(i, x, y, w) for i, ((x, y), w) in enumerate(zip(rows, times, strict=True))], "qid long, x int, y int, t double")

    def locate(self, points) -> DataFrame:
        """(qid, triangle_id) for pairs or a frame (qid, x, y)."""
        self._ready()
        return assign.locate(self._points(points), self._triangles, self._seeds).select("qid", "triangle_id")

    def in_circumsphere(self, points, t=None) -> DataFrame:
        """(qid, inside, triangle_id)."""
        self._ready()
        return assign.in_circumsphere(self._points(points, t), self._triangles, self._seeds)

    def get_seeds(self) -> DataFrame:
        self._ready()
        return self._seeds.select("ins_id", "x", "y").orderBy("ins_id")

    def get_values(self) -> DataFrame:
        return self._values().select(F.col("seed_id").alias("ins_id"), F.col("value").cast("float").alias("value")).orderBy("ins_id")

    def sorted_rank(self) -> DataFrame:
        self._ready()
        return self._ranked().select("ins_id", "seed_id")

    def get_voronoi_grid(self) -> DataFrame:
        """(px, py, seed_id, dist2) with insertion ids."""
        self._ready()
        own = self._seeds.select("seed_id", "ins_id")
        return voronoi.crop(self._raster, self.width, self.height).join(own, "seed_id").select("px", "py", F.col("ins_id").alias("seed_id"), "dist2")
