"""Exact dedup by a cuckoo-filter index over live digests.

A ``CuckooFilter`` holds 16-bit fingerprints of 64-bit digests in buckets of four; it supports insertion
and deletion. ``DigestIndex`` pairs it with a store of keys, bucketed by the same 64-bit digest: a filter
miss is a new key at once, a hit is verified against the stored content key (SHA-256 and byte length), and
an insertion that overflows doubles the filter and refills it from the stored keys.

The distributed form is a two-level tree. Every input split becomes a part of a written table of
(doc_id, row, sha256, bytes, part). A first index folds the rows of each part, so a group that holds a third of
all rows shrinks to one entry a part before anything is shuffled. The entries meet by digest in a second
index, whose answer returns to the rows by (digest, part): no key gathers more rows than one part has.

Defined edge cases: a null text counts as empty and equals other empty texts; the row with the largest
doc_id stays (a null doc_id is smaller than any other); columns other than the named ones are not read; repeated (doc_id, text) rows count in
``group_size`` and are all marked kept unless a row key is named, as nothing else tells them apart; with a row
key exactly one row of a group is kept, of the largest doc_id the one with the largest key; an empty table
gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._shared import fan_out, written

TASK_KEYS = 1_000_000  # entries that one task's index holds, on average
_NONE = -(1 << 63)


class CuckooFilter:
    """Partial-key cuckoo filter: no false negatives for what was inserted and not deleted."""

    SLOTS = 4

    def __init__(self, buckets: int = 1024, max_kicks: int = 200, seed: int = 1):
        self.buckets = 1 << max(1, (buckets - 1).bit_length())
        self.max_kicks = max_kicks
        self.table: list[list[int]] = [[] for _ in range(self.buckets)]
        self.random = random.Random(seed)
        self.size = 0

    def _places(self, digest: int) -> tuple[int, int, int]:
        mark = (digest >> 48) or 1
        first = digest & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def __contains__(self, digest: int) -> bool:
        mark, a, b = self._places(digest)
        return mark in self.table[a] or mark in self.table[b]

    def insert(self, digest: int) -> bool:
        """False if no room was found; the filter then has to be rebuilt, larger, from its keys."""
        mark, a, b = self._places(digest)
        for at in (a, b):
            if len(self.table[at]) < self.SLOTS:
                self.table[at].append(mark)
                self.size += 1
                return True
        at = self.random.choice((a, b))
        for _ in range(self.max_kicks):
            slot = self.random.randrange(self.SLOTS)
            mark, self.table[at][slot] = self.table[at][slot], mark
            at = self._other(at, mark)
            if len(self.table[at]) < self.SLOTS:
                self.table[at].append(mark)
                self.size += 1
                return True
        return False

    def delete(self, digest: int) -> bool:
        mark, a, b = self._places(digest)
        for at in (a, b):
            if mark in self.table[at]:
                self.table[at].remove(mark)
                self.size -= 1
                return True
        return False


class DigestIndex:
    """Live content keys with a value each. A key is any hashable whose first part is SHA-256 bytes."""

    def __init__(self, buckets: int = 1024, max_kicks: int = 200):
        self.filter = CuckooFilter(buckets, max_kicks)
        self.content: dict[int, dict] = {}  # 64-bit digest -> {content key: value}
        self.resizes = 0
        self.verified = 0

    @staticmethod
    def digest(key: tuple) -> int:
        return int.from_bytes(key[0][:8], "little")

    def __len__(self) -> int:
        return sum(map(len, self.content.values()))

    def get(self, key: tuple):
        """The live value of the key, or None. A filter miss needs no look at the content."""
        d = self.digest(key)
        if d not in self.filter:
            return None
        self.verified += 1
        return self.content.get(d, {}).get(key)

    def put(self, key: tuple, value) -> None:
        """Insert the key, or replace its live value."""
        d = self.digest(key)
        bucket = self.content.setdefault(d, {})
        fresh = not bucket
        bucket[key] = value
        if fresh and not self.filter.insert(d):
            self._resize()

    def delete(self, key: tuple) -> bool:
        d = self.digest(key)
        bucket = self.content.get(d)
        if not bucket or key not in bucket:
            return False
        del bucket[key]
        if not bucket:
            del self.content[d]
            self.filter.delete(d)
        return True

    def _resize(self) -> None:
        size = self.filter.buckets
        while True:
            size *= 2
            self.resizes += 1
            bigger = CuckooFilter(size, self.filter.max_kicks)
            if all(bigger.insert(d) for d in self.content):
                self.filter = bigger
                return

    def items(self) -> Iterator[tuple[tuple, object]]:
        for bucket in self.content.values():
            yield from bucket.items()


def fold(rows: Iterable[tuple], index: DigestIndex | None = None) -> DigestIndex:
    """Rows of (key, count, largest (id, row), part) into an index whose values are [count, largest (id, row), parts]."""
    index = DigestIndex() if index is None else index
    for key, n, top, part in rows:
        live = index.get(key)
        if live is None:
            index.put(key, [n, top, {part}])
        else:
            live[0] += n
            live[1] = max(live[1], top)
            live[2].add(part)
    return index


_PARTIAL = "sha binary, n_bytes long, part long, n long, top long, top_row long"
_MERGED = "sha binary, n_bytes long, part long, keep_id long, keep_row long, group_size long"


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def _fold_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # part comes into the key, so that parts which share a task stay apart
    index = DigestIndex()
    for batch in batches:
        fold((((sha, size, part), 1, (_NONE if i is None else i, row), part) for i, row, sha, size, part in _columns(batch, "doc_id", "row", "sha", "n_bytes", "part")), index)
    rows = [(k[0], k[1], k[2], v[0], *v[1]) for k, v in index.items()]
    yield from _emit(rows, ("sha", "n_bytes", "part", "n", "top", "top_row"))


def _merge_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = DigestIndex()
    for batch in batches:
        fold((((sha, size), n, (top, row), part) for sha, size, part, n, top, row in _columns(batch, "sha", "n_bytes", "part", "n", "top", "top_row")), index)
    rows = ((k[0], k[1], part, *v[1], v[0]) for k, v in index.items() if v[0] > 1 for part in v[2])
    yield from _emit(rows, ("sha", "n_bytes", "part", "keep_id", "keep_row", "group_size"))


def _emit(rows: Iterable[tuple], names: tuple[str, ...], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    kinds = [pa.binary()] + [pa.int64()] * (len(names) - 1)
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = zip(*held, strict=True) if held else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=list(names))

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """A written table (doc_id, row, sha, n_bytes, part): one scan of the texts, hashed in the JVM; ``row`` is 0 if no key is named."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return written(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            (F.lit(0) if row is None else F.col(row)).cast("long").alias("row"),
            F.unhex(F.sha2(body, 256)).alias("sha"),
            F.octet_length(body).cast("long").alias("n_bytes"),
            F.spark_partition_id().cast("long").alias("part"),
        ),
        "digests",
    )


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256, and ``row`` if a column of unique numbers is named."""
    rows = digests(docs, doc_id, text, row)
    partial = rows.mapInArrow(_fold_parts, _PARTIAL)
    tasks = fan_out(docs.sparkSession, rows.count(), TASK_KEYS)
    merged = partial.repartition(tasks, "sha").mapInArrow(_merge_parts, _MERGED)
    out = rows.join(merged, ["sha", "n_bytes", "part"], "left")
    keep = F.when(F.col("keep_id") == _NONE, F.lit(None).cast("long")).otherwise(F.col("keep_id"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(keep)
    kept = keep.eqNullSafe(F.col("doc_id")) if row is None else F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        kept.alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *([] if row is None else [F.col("row").alias(row)]),
    )
