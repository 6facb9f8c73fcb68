"""Near-duplicate classes by Order MinHash, with candidates verified by banded alignment.

A text is the sequence of its five-word shingles, each labelled with its occurrence number. One sketch
takes the ``PICKS`` shingles that are smallest under a random order and keeps them in text order, so it
agrees for texts that are close in edit distance and not merely in content; a text has ``SKETCHES`` of
them, and texts that share one are candidates. Two texts whose similarity is just 0.8 agree in one sketch with
probability 0.41, and in none of 24 with about 3e-6; of four against five shingles, the shortest case, with 0.5 %.

Similarity is L / (n1 + n2 - L), with L the longest common subsequence of the two shingle sequences, found by
aligning the places they share within the band that the threshold allows; 0.8 or more is a link, and classes
are the connected components of links.

No bucket is expanded into its pairs. Equal texts are one node from the start. Round one links every member
of a bucket to the member that has most company over all buckets. In buckets that still hold several
components, a shingle that only one component has cannot be part of a link between two; texts that keep too
few others to reach the threshold with any member of their bucket have no link left to find and drop out,
before any text of a pair meets another. What remains (``remaining``) goes to the last round, in blocks of
bounded size, where members are compared by their sketches and pairs of different components that share one
are aligned.

Defined edge cases: a text of one to four words is one shingle; texts without words are duplicates only when
equal; a null text equals other null or empty texts; rows with a null doc_id take part, and a class of such
rows only has a null class_id; rows of a class that share its class_id are all marked kept unless a row key is
named; with a row key exactly one of them is, the one with the least key; an empty table gives no rows; columns
other than the named ones are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._hashing import U64, mix, slices, text_buffers, word_hashes
from gridloom.llm._shared import few, written

WORDS = 5
SKETCHES = 24
PICKS = 4
BLOCK = 60_000  # shingles of the members that meet in one group of round two


def shingles(words: np.ndarray, width: int = WORDS) -> np.ndarray:
    """Hashes of the runs of ``width`` words; a shorter text is one run of all its words."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    with np.errstate(over="ignore"):
        out = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            out = (out + words[k : n - width + 1 + k]) * U64(0x9FB21C651E98DF25)
        return mix(out)


def label_occurrences(h: np.ndarray) -> np.ndarray:
    """Each shingle mixed with how often it came before, so that all are different."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.ones(len(h), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return h
    at = np.arange(len(h))
    count = at - np.maximum.accumulate(np.where(new, at, 0))
    seen = np.empty(len(h), np.uint64)
    seen[order] = count.astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.where(seen == 0, h, mix(h + seen * U64(0xA0761D6478BD642F)))


_ROWS = np.arange(1, SKETCHES + 1, dtype=np.uint64)
_FLIP = mix(_ROWS * U64(0xE7037ED1A0B428DB))[:, None]
_TIMES = (mix(_ROWS * U64(0x8EBC6AF09C88C6E3)) | U64(1))[:, None]


def sketch(h: np.ndarray) -> np.ndarray:
    """SKETCHES numbers for one text, from its labelled shingles in text order."""
    n = len(h)
    step = SKETCHES if n <= 50_000 else 1
    out = mix(_ROWS * U64(0x589965CC75374CC3))
    with np.errstate(over="ignore"):
        for a in range(0, SKETCHES, step):
            if n > PICKS:
                x = (h[None, :] ^ _FLIP[a : a + step]) * _TIMES[a : a + step]
                at = np.sort(np.argpartition(x, PICKS - 1, axis=1)[:, :PICKS], axis=1)
                picked = h[at]
            else:
                picked = np.broadcast_to(h, (step, n))
            for k in range(picked.shape[1]):
                out[a : a + step] = mix(out[a : a + step] * U64(0x1D8E4E27C47D124F) + picked[:, k])
    return out


def common_length(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence that pairs no places more than ``band`` apart.

    Both are first stripped of what they begin and end with in common. The places that hold the same number and
    lie within the band are then aligned by the longest chain that rises in both, which takes n log n steps
    as labelled shingles do not repeat.
    """
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    tail = 0
    if n:
        same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
        tail = n if same.all() else int(np.argmin(same))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    order = np.argsort(b, kind="stable")
    first, last = (np.searchsorted(b, a, side, order) for side in ("left", "right"))
    times = last - first
    i = np.repeat(np.arange(len(a)), times)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)]
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.lexsort((-j, i))]  # falling at one place of a, so that no two of them can chain
    if (np.diff(j) > 0).all():
        return head + tail + len(j)
    ends: list[int] = []
    for x in j.tolist():
        at = bisect_left(ends, x)
        if at == len(ends):
            ends.append(x)
        else:
            ends[at] = x
    return head + tail + len(ends)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sequences have similarity 0.8 or more; in whole numbers, 9 L >= 4 (n1 + n2)."""
    both = len(a) + len(b)
    if not len(a) or not len(b):
        return False
    if 9 * min(len(a), len(b)) < 4 * both:
        return False
    return 9 * common_length(a, b, both // 9 + 1) >= 4 * both


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 2):
            words, counts = word_hashes(*text_buffers(batch.column(2)))
            ends = np.cumsum(counts)
            sizes, found = [], []
            for a, b in zip(ends - counts, ends, strict=True):
                h = label_occurrences(shingles(words[a:b]))
                sizes.append(len(h))
                found.append(sketch(h).view(np.int64) if len(h) else np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), batch.column(3)],
                names=["doc_id", "sha", "n", "sketch", "row"],
            )


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """A written table (doc_id, sha, n, sketch, row): one scan of the texts. Rows are numbered here if no key is named."""
    key = F.monotonically_increasing_id() if row is None else F.col(row).cast("long")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _sha(F.col(text)).alias("sha"), F.col(text).alias("text"), key.alias("row"))
    return written(rows.mapInArrow(_sketch_batches, "doc_id long, sha binary, n long, sketch array<long>, row long"), "sketches")


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, part, v, text) come with the text of u first, as a row whose v is null, then those to compare with it."""
    last, held = None, np.zeros(0, np.uint64)
    for batch in batches:
        for piece in slices(batch, 3):
            words, counts = word_hashes(*text_buffers(piece.column(3)))
            ends = np.cumsum(counts)
            us, vs = [], []
            for u, v, lo, hi in zip(piece.column(0).to_pylist(), piece.column(2).to_pylist(), ends - counts, ends, strict=True):
                own = label_occurrences(shingles(words[lo:hi]))
                if v is None:
                    last, held = u, own
                elif u == last and alike(held, own):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def node_texts(wanted: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A written table (node, text) of the wanted (node, sha, first_id): each text once, by one scan."""
    body = docs.select(F.col(doc_id).cast("long").alias("id"), _sha(F.col(text)).alias("own"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    same = body["own"].eqNullSafe(wanted["sha"]) & body["id"].eqNullSafe(wanted["first_id"])
    return written(body.join(few(wanted), same).select("node", "text").dropDuplicates(["node"]), "texts")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """A written table of the pairs (u, v, n) whose texts align; n is the size of v.

    A u that has many v is cut into parts of about BLOCK shingles. Its text goes once to each part, and the
    others follow it one by one, so neither a hot u nor its part is held whole.
    """
    parts = written(pairs.groupBy("u").agg(F.ceil(F.sum("n") / BLOCK).alias("parts")), "heads")
    own = pairs.join(few(parts), "u").select("u", F.pmod(F.xxhash64("v"), F.greatest("parts", F.lit(1))).alias("part"), "v")
    heads = own.select("u", "part").distinct().join(texts.withColumnRenamed("node", "u"), "u")
    heads = heads.select("u", "part", F.lit(None).cast("long").alias("v"), "text")
    rows = heads.unionByName(own.join(texts.withColumnRenamed("node", "v"), "v").select("u", "part", "v", "text"))
    rows = rows.repartition("u", "part").sortWithinPartitions("u", "part", F.asc_nulls_first("v"))
    return written(rows.mapInArrow(_verify_batches, "u long, v long"), "links")


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """A written table (node, label) over the nodes of ``links``: the least node of each component.

    Each round takes the least label among neighbours and then the label of that label; the tables between
    rounds are written, so no plan grows with the number of rounds.
    """
    edges = written(links.select("u", "v").union(links.select("v", "u")).where("u <> v").distinct(), "edges")
    if labels is None:
        labels = edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label"))
        labels = written(labels, "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node", "left").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        after = hooked.join(jump, "low", "left").select("node", "label", F.least("low", "far").alias("next"))
        after = written(after, "labels")
        moved = after.where("next <> label").limit(1).count()
        labels = after.select("node", F.col("next").alias("label"))
        if not moved:
            return labels


def _aligned_block(key: tuple, rows: pa.Table) -> pa.Table:
    """Links between the lone members of one block and the members of another, of different components."""
    node, n, label, band = (rows.column(x).to_numpy() for x in ("node", "n", "label", "band"))
    lone = rows.column("lone").to_numpy(zero_copy_only=False)
    marks = np.stack(rows.column("sketch").to_pylist())
    words, counts = word_hashes(*text_buffers(rows.column("text").combine_chunks()))
    ends = np.cumsum(counts)
    grams: dict[int, np.ndarray] = {}

    def of(i: int) -> np.ndarray:
        if i not in grams:
            grams[i] = label_occurrences(shingles(words[ends[i] - counts[i] : ends[i]]))
        return grams[i]

    root = {int(x): int(x) for x in label}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    us, vs = [], []
    others = np.flatnonzero(~lone)
    for i in np.flatnonzero(lone):
        agree = marks[others] == marks[i]
        near = agree.any(axis=1) & (agree.argmax(axis=1) == band[i])  # a pair belongs to its first common bucket
        near &= (label[others] != label[i]) & (9 * np.minimum(n[others], n[i]) >= 4 * (n[others] + n[i]))
        for j in others[near]:
            a, b = find(int(label[i])), find(int(label[j]))
            if a != b and alike(of(i), of(j)):
                us.append(int(node[i]))
                vs.append(int(node[j]))
                root[a] = b
    return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1):
            words, counts = word_hashes(*text_buffers(batch.column(1)))
            ends = np.cumsum(counts)
            found = [label_occurrences(shingles(words[a:b])) for a, b in zip(ends - counts, ends, strict=True)]
            label = np.repeat(batch.column(0).to_numpy(), [len(h) for h in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)) if found else pa.array([], pa.int64()), pa.array(label)], names=["h", "label"])


def _open_buckets(members: DataFrame) -> DataFrame:
    """A written table of the members of the buckets that hold several components."""
    mixed = members.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min("n").alias("least")).where("a < b").select("key", "least")
    return written(members.join(few(written(mixed, "mixed")), "key"), "open")


def remaining(buckets: DataFrame, labels: DataFrame, texts: DataFrame, rounds: int = 4) -> DataFrame:
    """A written table (key, band, node, n, label, main, size, others): members of the buckets in which a link may still be missing.

    ``main`` is the component with most members of the bucket. A text that is a component by itself and has u shingles
    that no other component has can share n - u of them at most. It leaves a bucket where that is too few for the
    smallest member, and a bucket with one component left leaves as a whole. What leaves takes its shingles along,
    so this is done again while it helps, ``rounds`` times at most; more rounds would change the work only.
    """
    members = buckets.where("c > 2").join(labels, "node", "left").select("key", "band", "node", "n", F.coalesce("label", "node").alias("label"))
    members = _open_buckets(members)
    n = members.count()
    for _ in range(rounds):
        nodes = written(members.groupBy("node").agg(F.first("label").alias("label")), "members")
        grams = texts.join(few(nodes), "node").select("label", "text").mapInArrow(_shingle_batches, "h long, label long")
        own = grams.groupBy("h").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top").groupBy("label").agg(F.count(F.lit(1)).alias("own"))
        alone = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where("size = 1").join(own, "label").select(F.col("label").alias("node"), "own")
        bounded = members.join(few(written(alone, "alone")), "node", "left").withColumn("share", F.col("n") - F.coalesce("own", F.lit(0)))
        able = bounded.where("9 * share >= 4 * (n + greatest(least, share))").select("key", "band", "node", "n", "label")
        members, before = _open_buckets(able), n
        n = members.count()
        if n > 0.9 * before:
            break
    sizes = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("size"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("k", "label", "size")).alias("top"), F.sum("size").alias("size"))
    deal = sizes.select("key", F.col("top.label").alias("main"), "size", (F.col("size") - F.col("top.size")).alias("others"))
    return written(members.join(few(written(deal, "deal")), "key"), "remaining")


def last_round(rest: DataFrame, texts: DataFrame, single: DataFrame) -> DataFrame:
    """A written table of links (u, v) among ``remaining`` members: those outside the main component against all, in blocks."""
    rest = rest.withColumns({"blocks": F.ceil(F.col("size") / BLOCK), "lone_blocks": F.ceil((F.col("others") + 1) / (BLOCK // 2))})
    spread = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    full = rest.join(texts, "node").join(single.select("node", "sketch"), "node")
    right = full.select("key", "band", "node", "n", "label", "text", "sketch", F.lit(False).alias("lone"), spread("blocks", 1).alias("b"), every("lone_blocks").alias("a"))
    left = full.where("label <> main").select("key", "band", "node", "n", "label", "text", "sketch", F.lit(True).alias("lone"), every("blocks").alias("b"), spread("lone_blocks", 2).alias("a"))
    return written(right.unionByName(left).groupBy("key", "a", "b").applyInArrow(_aligned_block, "u long, v long").distinct(), "links")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One row a document: doc_id, class_id (least doc_id of its class), class_size, kept, and ``row`` if a column of unique numbers is named."""
    rows = sketches(docs, doc_id, text, row)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "row")).alias("first")  # null ids last
    nodes = rows.groupBy("sha").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), first)
    nodes = written(nodes, "nodes")
    single = written(rows.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "n", "sketch"), "single")
    bands = single.select("node", "n", F.posexplode("sketch").alias("band", "key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    buckets = written(bands.join(shared, "key"), "buckets")
    company = written(buckets.groupBy("node").agg(F.sum("c").alias("company")), "company")
    texts = node_texts(written(company.join(nodes, "node").select("node", "sha", "first_id"), "wanted"), docs, doc_id, text)

    # round one: every member against the member of its bucket that has most company
    leaders = buckets.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node", "n")).alias("top"))
    leaders = few(written(leaders.select("key", F.col("top.node").alias("u"), F.col("top.n").alias("m")), "leaders"))
    fits = F.lit(9) * F.least("n", "m") >= F.lit(4) * (F.col("n") + F.col("m"))
    stars = buckets.join(leaders, "key").where((F.col("node") != F.col("u")) & fits).groupBy("u", F.col("node").alias("v")).agg(F.first("n").alias("n"))
    links = verified(written(stars, "stars"), texts)
    labels = components(links)

    rest = remaining(buckets, labels, texts)
    more = last_round(rest, texts, single)
    if more.limit(1).count():
        labels = components(links.union(more))

    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = named.groupBy("label").agg(F.min("first_id").alias("class_id"), F.min("first").alias("top"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("texts")).where("class_size > 1")
    member = named.join(classes, "label").select("sha", "class_id", F.col("top.row").alias("class_row"), "class_size", F.lit(True).alias("grouped"))
    out = rows.select("doc_id", "sha", "row").join(member, "sha", "left")
    top = F.when(F.col("grouped"), F.col("class_id")).otherwise(F.col("doc_id"))
    kept = top.eqNullSafe(F.col("doc_id")) if row is None else F.coalesce(F.col("class_row") == F.col("row"), F.lit(True))
    own = [] if row is None else [F.col("row").alias(row)]
    return out.select("doc_id", top.alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), kept.alias("kept"), *own)
