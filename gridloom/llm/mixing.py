"""Mixing sources to target weights with packed blocks and pseudorandom index permutations.

The words of each source, its documents in id order, are packed into blocks of ``BLOCK`` words. Every output
shard draws multinomial source counts; the draws are then evened out so that each source's total is its
quota. The slots of a source are numbered across the shards, slot k stands for place k modulo the number of
blocks in the pass k divided by it, and a keyed Feistel permutation maps the place to a block index. Blocks
are joined by (source, index). In a pass every block comes once, so a source taken q times over uses each
block q times or one time more.

Targets share the total of all sizes by weight and stop at ``LIMIT`` times the source's size; what is above
goes to the other sources by weight, until none is above. The list of sources, one short row each, is held
by the driver; rows of documents and blocks never are.

Defined edge cases: a null text has size 0 and nothing is taken from it; the null source is a source of its
own and the last; rows with a null or repeated id are laid out by size and then by the row key, if one is named;
a source without words has target 0; an empty table gives no rows. Reruns agree, as all draws depend on the
seed, the sources and the sizes only.

Ids do not tell rows apart. Whoever wants the words of each row (``mixed_texts``) names a column with a unique
row key, as ``_shared.keyed`` writes it, to ``mix`` and to ``mixed_texts``, which are then joined by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm._hashing import slices, text_buffers, word_spans
from gridloom.llm._shared import WORD, fan_out, written

BLOCK = 64
LIMIT = 3
CHUNK_ROWS = 50_000  # rows that are laid out by one task, on average
SLOT_STEP = 20_000  # slots of one range
SLOT_TASK = 1_000_000  # slots of one task
_NULL = "\x00null"


def fill_targets(sizes: list[int], weights: list[float], limit: float = LIMIT) -> list[float]:
    """Targets that share the total of sizes by weight, none above ``limit`` times its own size."""
    total, n = float(sum(sizes)), len(sizes)
    target, full = [0.0] * n, [s == 0 for s in sizes]
    left = total
    while not all(full):
        unit = left / sum(w for w, f in zip(weights, full, strict=True) if not f)
        above = [i for i in range(n) if not full[i] and weights[i] * unit > limit * sizes[i]]
        if not above:
            for i in range(n):
                if not full[i]:
                    target[i] = weights[i] * unit
            break
        for i in above:
            target[i], full[i] = float(limit * sizes[i]), True
            left -= target[i]
    return target


def apportion(n: int, have: list[int]) -> list[int]:
    """n split in proportion to ``have``, by largest remainders; none gets more than it has if n is at most their sum."""
    total = sum(have)
    if not total:
        return [0] * len(have)
    out, rest = map(list, zip(*(divmod(n * x, total) for x in have), strict=True))
    for i in sorted(range(len(have)), key=lambda i: (-rest[i], i))[: n - sum(out)]:
        out[i] += 1
    return out


def draw_counts(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources) slot counts: a multinomial draw a shard, evened out to the quotas.

    What a source drew above its quota is given back, and what it lacks added, in proportion to what each shard drew.
    """
    rng = np.random.default_rng(seed)
    total = sum(quotas)
    if not total:
        return np.zeros((shards, len(quotas)), np.int64)
    share = np.array(quotas, float) / total
    per = [total // shards + (h < total % shards) for h in range(shards)]
    counts = [rng.multinomial(n, share / share.sum()).tolist() for n in per]
    for s, quota in enumerate(quotas):
        drew = [row[s] for row in counts]
        excess = sum(drew) - quota
        even = apportion(abs(excess), drew if sum(drew) >= abs(excess) else per)
        for h in range(shards):
            counts[h][s] += -even[h] if excess > 0 else even[h]
    return np.array(counts, np.int64)


def permute(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1 for each element: a Feistel network, walked until it falls inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = k.astype(np.uint64)
    todo = np.ones(len(k), bool)
    bound, key = n.astype(np.uint64), key.astype(np.uint64)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right, m, c = out[todo] >> half[todo], out[todo] & mask[todo], mask[todo], key[todo]
            for r in range(4):
                x = (right ^ c) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((r * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & (2**64 - 1))
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((x >> np.uint64(32)) & m)
            out[todo] = (left << half[todo]) | right
            todo = out >= bound
    return out.astype(np.int64)


def layout(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """A written table (doc_id, src, size, first, row): the place of each document's first word in its source.

    ``row`` names a column of unique numbers; without it the rows are numbered here.

    Offsets are sums by hash chunk first, then within a chunk, so a source of any size is spread over many groups.
    A chunk is a hash of the id and the text; their number follows the number of rows. Rows of one id with different
    texts are spread; only equal rows share a chunk, and the partition they were read in spreads these over 64.
    """
    own = [] if row is None else [F.col(row).alias("row")]
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit(_NULL)).alias("src"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text).alias("h"), F.pmod(F.spark_partition_id(), F.lit(64)).alias("split"), *own
    )
    rows = written(rows.withColumn("h", F.xxhash64("doc_id", F.col("h"))), "sizes")
    twice = rows.groupBy("src", "h").agg(F.count(F.lit(1)).alias("n")).where(f"n > {CHUNK_ROWS}")  # few: each is many rows
    rows = rows.join(F.broadcast(twice.select("src", "h", F.lit(64).alias("parts"))), ["src", "h"], "left")
    rows = rows.withColumn("part", F.pmod("split", F.coalesce("parts", F.lit(1))))
    chunks = max(1024, rows.count() // CHUNK_ROWS)
    rows = rows.withColumn("chunk", F.pmod("h", F.lit(chunks)).cast("int")).drop("h", "split", "parts")
    sums = rows.groupBy("src", "chunk", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("src").orderBy("chunk", "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "chunk", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("src", "chunk", "part").orderBy("doc_id", "size", *(["row"] if own else [])).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    key = F.col("row") if own else F.monotonically_increasing_id().alias("row")
    return written(rows.join(sums, ["src", "chunk", "part"]).select("doc_id", "src", "size", (F.col("base") + F.col("inner")).alias("first"), key), "layout")


def plan(laid: DataFrame, weights: tuple[float, ...] = (1, 2, 3), limit: float = LIMIT, block: int = BLOCK) -> pd.DataFrame:
    """One row a source on the driver: src, source_size, target, blocks, quota (slots)."""
    found = {r["src"]: int(r["n"]) for r in laid.groupBy("src").agg(F.sum("size").alias("n")).collect()}
    names = sorted((s for s in found if s != _NULL)) + [_NULL] * (_NULL in found)
    sizes = [found[s] for s in names]
    target = fill_targets(sizes, [float(weights[i % len(weights)]) for i in range(len(names))], limit)
    blocks = [-(-n // block) for n in sizes]
    quota = [min(int(limit) * b, round(t * b / n)) if n else 0 for t, b, n in zip(target, blocks, sizes, strict=True)]
    return pd.DataFrame({"src": names, "source_size": sizes, "target": target, "blocks": blocks, "quota": quota})


def draw_slots(laid: DataFrame, sources: pd.DataFrame, shards: int = 64, seed: int = 17) -> DataFrame:
    """One row a slot of the output: shard, place in the shard, src, index of the block that fills it."""
    spark = laid.sparkSession
    counts = draw_counts([int(q) for q in sources["quota"]], shards, seed)
    starts = np.vstack([np.zeros(counts.shape[1], np.int64), np.cumsum(counts, axis=0)[:-1]]) if len(counts) else counts
    places = np.hstack([np.zeros((shards, 1), np.int64), np.cumsum(counts, axis=1)[:, :-1]]) if counts.shape[1] else counts
    rows = [
        (int(h), s.src, int(s.blocks), int(starts[h, i]), int(places[h, i]), int(counts[h, i]), i + 1)
        for h in range(shards)
        for i, s in enumerate(sources.itertuples())
        if counts[h, i]
    ]
    drawn = spark.createDataFrame(rows, "shard int, src string, blocks long, start long, place long, n long, no int")
    ranges = drawn.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLOT_STEP).cast("long"))))
    tasks = fan_out(spark, int(counts.sum()), SLOT_TASK)
    ranges = ranges.repartition(tasks, "shard", "src", "from")  # a stated number: by their bytes the short ranges would become one task
    slots = ranges.withColumn("i", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + SLOT_STEP, F.col("n")) - 1)))
    slots = slots.select("shard", "src", "blocks", "no", (F.col("place") + F.col("i")).alias("place"), (F.col("start") + F.col("i")).alias("slot"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            turn, k = np.divmod(b["slot"].to_numpy(), b["blocks"].to_numpy())
            key = (turn * 1_000_003 + b["no"].to_numpy() * 8191 + seed).astype(np.uint64)
            yield pd.DataFrame({"shard": b["shard"], "place": b["place"], "src": b["src"], "block": permute(k, b["blocks"].to_numpy(), key)})

    return slots.mapInPandas(run, "shard int, place long, src string, block long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), shards: int = 64, seed: int = 17, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """One row a document: doc_id, size, source, source_size, target, first, taken, uses (array of (block, times)), and ``row`` if named."""
    spark = docs.sparkSession
    laid = layout(docs, doc_id, text, source, row)
    sources = plan(laid, weights, LIMIT, block)
    slots = draw_slots(laid, sources, shards, seed)
    uses = slots.groupBy("src", "block").agg(F.count(F.lit(1)).alias("times"))
    spans = laid.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"(first + size - 1) div {block}"))))
    spans = spans.join(uses, ["src", "block"])
    words = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("first"), F.col("block") * block)
    taken = spans.groupBy("row").agg(F.sum(words * F.col("times")).alias("taken"), F.sort_array(F.collect_list(F.struct("block", "times"))).alias("uses"))
    rows = [(s.src, int(s.source_size), float(s.target)) for s in sources.itertuples()]
    known = spark.createDataFrame(rows, "src string, source_size long, target double")
    out = laid.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    out = out.join(F.broadcast(known), "src")
    return out.select("doc_id", "size", F.when(F.col("src") != _NULL, F.col("src")).alias("source"), "source_size", "target", "first", "taken", "uses", *([] if row is None else [F.col("row").alias(row)]))


def mixed_texts(docs: DataFrame, mixed: DataFrame, block: int = BLOCK, row: str | None = None) -> DataFrame:
    """The words that the mix takes, as rows of ``docs`` (doc_id, text, lang, source, n_chars).

    A document gives one row for each pass that uses any of its blocks: the text of the blocks used in that
    many passes or more, runs of neighbouring blocks as they stand and a space between runs.

    ``row`` names the row key of both tables. Without it they are joined by id, and a null or repeated id among
    the mixed rows is an error, since the words of such rows would be lost or cut from other rows.
    """
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if row is None and mixed.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count():
        raise ValueError("ids are null or repeated; name a unique row key")
    key = row or "doc_id"
    taken = mixed.where("taken > 0").select(key, "first", "uses")
    rows = docs.join(taken, key).select("doc_id", "text", "lang", "source", "first", "uses.block", "uses.times")

    def cut(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: int, blocks: np.ndarray, times: np.ndarray) -> Iterator[str]:
        for turn in range(1, int(times.max()) + 1):
            held = blocks[times >= turn]
            breaks = np.flatnonzero(np.diff(held) > 1)
            parts = []
            for a, b in zip(np.append(0, breaks + 1), np.append(breaks, len(held) - 1), strict=True):
                lo, hi = max(0, int(held[a]) * block - first), min(len(start), (int(held[b]) + 1) * block - first)
                if hi > lo:
                    parts.append(data[start[lo] : end[hi - 1]].tobytes().decode())
            yield " ".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                data, offsets = text_buffers(batch.column(1))
                start, end, counts = word_spans(data, offsets)
                ends = np.cumsum(counts)
                out = []
                doc, lang, source, first, blocks, times = (batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6))
                for i in range(batch.num_rows):
                    lo = ends[i] - counts[i]
                    for x in cut(data, start[lo : ends[i]], end[lo : ends[i]], first[i], np.array(blocks[i]), np.array(times[i])):
                        out.append({"doc_id": doc[i], "text": x, "lang": lang[i], "source": source[i], "n_chars": len(x)})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]))

    return rows.mapInArrow(run, schema)
