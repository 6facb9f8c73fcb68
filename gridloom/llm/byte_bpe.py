"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary resolves a whole pre-token that is a token itself.
Second tier: the others are merged from single bytes, kept as a linked list, with a heap of ranked pairs;
stale heap entries are skipped. A bounded memo in front of both keeps what frequent pre-tokens encode to.

A worker loads the rank file once, from the path it is given; nothing is copied or trained. Memory is
bounded: vocabulary, two memos of two generations (up to ``MEMO`` words or ``MEMO // 2`` pieces in each, of up to
``MEMO_CHARS`` characters) and one Arrow batch.

Defined edge cases: a null or empty text has no ids and decodes to no bytes; ids that are not in the
vocabulary raise ``KeyError``; white space, control characters and unassigned code points are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO = 350_000
MEMO_CHARS = 48
#: White space other than the space and the line feed.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class MinimalPerfectHash:
    """Hash and displace: n keys in n places, one displacement for each small group of keys.

    Groups are placed from the largest to the smallest; a group of one key takes a free place directly,
    written as the negative number ``-1 - place``.
    """

    def __init__(self, keys: Iterable[bytes], values: Iterable[int], group: int = 2):
        pairs = list(zip(keys, values, strict=True))
        self.n = len(pairs)
        self.groups = max(1, self.n // group)
        self.shift = [0] * self.groups
        self.keys: list[bytes] = [b""] * self.n
        self.values = [-1] * self.n
        members: list[list] = [[] for _ in range(self.groups)]
        for key, value in pairs:
            h = xxhash.xxh3_128_intdigest(key)
            members[(h >> 96) % self.groups].append((h, key, value))
        taken = bytearray(self.n)
        free = 0
        for g in sorted(range(self.groups), key=lambda g: -len(members[g])):
            if not members[g]:
                break
            if len(members[g]) == 1:
                while taken[free]:
                    free += 1
                s = free
                taken[s] = 1
                self.shift[g] = -1 - s
                _, self.keys[s], self.values[s] = members[g][0]
                continue
            shift = 0
            while True:
                spots = [self._spot(h, shift) for h, _, _ in members[g]]
                if len(set(spots)) == len(spots) and not any(taken[s] for s in spots):
                    break
                shift += 1
            self.shift[g] = shift
            for s, (_, key, value) in zip(spots, members[g], strict=True):
                taken[s] = 1
                self.keys[s], self.values[s] = key, value

    def _spot(self, h: int, shift: int) -> int:
        if shift < 0:
            return -1 - shift
        return ((h & 0xFFFFFFFF) + shift * ((h >> 32 & 0xFFFFFFFF) | 1)) % 4294967291 % self.n

    def get(self, key: bytes) -> int | None:
        """The value of the key; None if it is not one of the n keys, which the stored key tells."""
        if not self.n:
            return None
        h = xxhash.xxh3_128_intdigest(key)
        s = self._spot(h, self.shift[(h >> 96) % self.groups])
        return self.values[s] if self.keys[s] == key else None


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Memo(dict):
    """Remembers what a piece of text encodes to, in two generations of up to ``limit`` pieces of MEMO_CHARS characters.

    A full generation becomes the older one, whose pieces come back when they are met again; those that are not
    met before the next is full are forgotten.
    """

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        got = self.older.get(piece)
        if got is None:
            got = self.encode(piece)
        if len(piece) <= MEMO_CHARS and "\n" not in piece:  # two words across a line end hardly come again
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = got
        return got


class ByteBPE:
    """``lone_spaces``: in this pattern a lone space between two characters that are no white space always
    starts a match, so a text may be cut before such spaces and each cut matched by itself. It holds for
    patterns whose words take one optional leading space."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO, lone_spaces: bool = True):
        self.ranks = ranks
        self.whole = MinimalPerfectHash(ranks.keys(), ranks.values())
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.text_of = {v: str(v) for v in ranks.values()}
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.split = regex.compile(pattern).findall
        self.memo = _Memo(lambda piece: self.encode_piece(piece.encode()), memo // 2)
        self.words = _Memo(self._word, memo)  # what follows a lone space
        self.lone_spaces = lone_spaces

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        found = self.whole.get(piece)
        return (found,) if found is not None else self.merge(piece)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Lowest rank first, leftmost among equals; the bytes are linked by ``after`` and ``before``."""
        n = len(piece)
        if n < 2:
            return tuple(self.single[b] for b in piece)
        ranks = self.ranks.get
        end = list(range(1, n + 1))  # where the part that starts at i ends: its link to the next part
        before = list(range(-1, n))
        wide = n.bit_length()  # a heap entry is one integer: rank, start, end
        mask, high = (1 << wide) - 1, 2 * wide
        heap = [(r << high) | (i << wide) | (i + 2) for i, r in enumerate([ranks(piece[i : i + 2]) for i in range(n - 1)]) if r is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            stop, i = entry & mask, (entry >> wide) & mask
            j = end[i]
            if j == n or not j or end[j] != stop:
                continue  # one of the two parts has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                r = ranks(piece[i : end[stop]])
                if r is not None:
                    push(heap, (r << high) | (i << wide) | end[stop])
            k = before[i]
            if k >= 0:
                r = ranks(piece[k:stop])
                if r is not None:
                    push(heap, (r << high) | (k << wide) | stop)
        out, i = [], 0
        while i < n:
            j = end[i]
            out.append(self.ranks[piece[i:j]])
            i = j
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if not self.lone_spaces or not text:
            return list(self._matches(text))
        if _OTHER_SPACE.search(text) or "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
            return list(self._matches(text))
        parts = text.split(" ")  # every cut is before a lone space
        return [*self._matches(parts[0]), *chain.from_iterable(map(self.words.__getitem__, parts[1:]))]

    def _word(self, word: str) -> tuple[int, ...]:
        found = self.split(" " + word)
        if len(found) == 1:  # remembered as a word, so not as a piece too
            return self.encode_piece(found[0].encode())
        return tuple(chain.from_iterable(map(self.memo.__getitem__, found)))

    def _matches(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.memo.__getitem__, self.split(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(load_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, ids (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for rows in _slices(batch):
                ids = [bpe.encode(x) if x else [] for x in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row a document: doc_id, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for rows in _slices(batch):
                back = [bpe.decode(x or ()) for x in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(back, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256, lossless."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_()]

    def row(bpe: ByteBPE, text: str) -> tuple:
        ids = bpe.encode(text)
        back = bpe.decode(ids)
        shown = " ".join(map(bpe.text_of.__getitem__, ids))
        return len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(back).hexdigest(), back == text.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for rows in _slices(batch):
                got = [row(bpe, x or "") for x in rows.column(1).to_pylist()]
                cols = zip(*got, strict=True) if got else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
