"""Sharding by fixed virtual slots, in native DataFrame expressions only.

A record belongs to one of ``SLOTS`` virtual slots, by a hash of its id and its text's checksum, so that rows which
share an id still spread. Bytes are aggregated by slot, and a versioned map gives the shard of each slot.
Rebalancing edits the map and leaves the records' slots alone: version 1 deals the slots in turn; each later version
moves as few slots as bring the shards' bytes close together. Versions are tables in one folder, and ``SlotMaps.reopen``
goes on from the last of them. The map has SLOTS rows at any size of input, so it may be held by the driver and
broadcast.

The law that holds is ``bytes``: no single move of a slot from the fullest to the emptiest shard would
bring those two closer. A record's place inside its shard is ``slot``, gapless from 0: the slots of a shard
are laid one after another, and each slot is numbered in ``PARTS`` parts by the split a record was read in, so
no task has a whole shard, nor all of a slot whose rows are equal.

Defined edge cases: a null text has size 1 (no bytes, plus one) and the CRC of no bytes; a null id counts as an empty
one; equal rows share a virtual slot; an empty table gives no rows; columns other than the named ones are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.llm._shared import shared_dir, written

SLOTS = 4096
PARTS = 64
MAP_SCHEMA = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("vslot", T.IntegerType()), T.StructField("shard", T.IntegerType())])


def virtual_slot(key: Column, text_crc32: Column) -> Column:
    """The first 12 bits of the MD5 of the id's decimal text (a null id: none), a colon and the checksum."""
    name = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), text_crc32.cast("string"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 3), 16, 10).cast("int")


def first_map(shards: int) -> list[int]:
    return [s % shards for s in range(SLOTS)]


def rebalance(shard_of: list[int], load: list[int], shards: int) -> list[int]:
    """An edited copy of the map whose shards hold nearly equal loads; slots stay where they can.

    Shards above the mean by more than a thousandth shed their largest slots that fit the excess, the shed
    slots go to the emptiest shards, largest first, and single moves then go on while they bring the fullest
    and the emptiest closer. Each such move lowers the sum of the squared loads, so they end.
    """
    out = list(shard_of)
    total = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for s, k in enumerate(out):
        k = out[s] = k if k < shards else s % shards
        total[k] += load[s]
        held[k].append(s)
    mean = sum(load) / shards
    loose = []
    for k in (k for k in range(shards) if total[k] > 1.001 * mean):
        for s in sorted(held[k], key=lambda s: (-load[s], s)):
            if 0 < load[s] <= total[k] - mean:
                total[k] -= load[s]
                held[k].remove(s)
                loose.append(s)
    for s in sorted(loose, key=lambda s: (-load[s], s)):
        k = min(range(shards), key=lambda k: (total[k], k))
        out[s] = k
        total[k] += load[s]
        held[k].append(s)
    while True:
        a = max(range(shards), key=lambda k: (total[k], -k))
        b = min(range(shards), key=lambda k: (total[k], k))
        gap = total[a] - total[b]
        fits = [s for s in held[a] if 0 < load[s] < gap]
        if not fits:
            break
        s = min(fits, key=lambda s: (abs(gap - 2 * load[s]), s))
        held[a].remove(s)
        held[b].append(s)
        out[s] = b
        total[a] -= load[s]
        total[b] += load[s]
    return out


class SlotMaps:
    """Versions of the slot-to-shard map, each a table ``v<version>`` under ``path`` (by default a new shared folder)."""

    def __init__(self, spark: SparkSession, shards: int, path: str | None = None):
        self.spark, self.shards = spark, shards
        self.path = (path or f"{shared_dir(spark)}/slot-maps-{uuid.uuid4().hex}").rstrip("/")
        self.versions: list[list[int]] = []
        self.tables: list[DataFrame] = []
        self.edit(first_map(shards))

    @classmethod
    def reopen(cls, spark: SparkSession, path: str) -> SlotMaps:
        """The maps that an earlier run left under ``path``; the next edit makes the next version."""
        self = cls.__new__(cls)
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/v*").collect()  # SLOTS rows a version
        last = max(r["version"] for r in rows)
        self.versions = [[0] * SLOTS for _ in range(last)]
        for r in rows:
            self.versions[r["version"] - 1][r["vslot"]] = r["shard"]
        self.tables = [spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/v{k}") for k in range(1, last + 1)]
        self.shards = max(self.versions[-1]) + 1
        return self

    @property
    def version(self) -> int:
        return len(self.versions)

    def edit(self, shard_of: list[int]) -> DataFrame:
        """Store the next version. One that is there already is an error, as another run has edited the map."""
        rows = [(self.version + 1, s, k) for s, k in enumerate(shard_of)]
        at = f"{self.path}/v{self.version + 1}"
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(at)
        self.versions.append(shard_of)
        self.tables.append(self.spark.read.schema(MAP_SCHEMA).parquet(at))
        return self.tables[-1]

    def rebalance(self, load: list[int], shards: int | None = None) -> DataFrame:
        self.shards = shards or self.shards
        return self.edit(rebalance(self.versions[-1], load, self.shards))


def slot_records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table (doc_id, size, text_crc32, vslot, part): the only scan of the texts."""
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return written(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            crc.alias("text_crc32"),
            virtual_slot(F.col(doc_id), crc).alias("vslot"),
            F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part"),
        ),
        "slot-records",
    )


def slot_loads(records: DataFrame) -> tuple[list[int], list[int]]:
    """Bytes and rows by virtual slot: SLOTS numbers each, whatever the size of the table."""
    load, rows = [0] * SLOTS, [0] * SLOTS
    for s, size, n in records.groupBy("vslot").agg(F.sum("size"), F.count(F.lit(1))).collect():
        load[s], rows[s] = int(size), int(n)
    return load, rows


def shard(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", maps: SlotMaps | None = None) -> DataFrame:
    """One row a record: doc_id, size, text_crc32, shard, slot (place in the shard), vslot, map_version."""
    spark = docs.sparkSession
    records = slot_records(docs, doc_id, text)
    load, rows = slot_loads(records)
    maps = SlotMaps(spark, shards) if maps is None else maps
    shard_map = maps.rebalance(load, shards)
    starts, used = [], [0] * shards
    for s, k in enumerate(maps.versions[-1]):
        starts.append((s, used[k]))
        used[k] += rows[s]
    begin = spark.createDataFrame(starts, "vslot int, begin long")
    shard_map = shard_map.join(F.broadcast(begin), "vslot")
    earlier = Window.partitionBy("vslot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = records.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n"))  # SLOTS * PARTS rows at most
    parts = parts.select("vslot", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size")
    placed = records.withColumn("place", F.row_number().over(within).cast("long") - 1).join(parts, ["vslot", "part"])
    return placed.join(F.broadcast(shard_map), "vslot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("ahead") + F.col("place")).alias("slot"), "vslot", F.col("version").alias("map_version")
    )
