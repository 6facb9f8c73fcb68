"""Language-model scoring by deleted interpolation of word n-grams.

The model mixes maximum-likelihood estimates of the bigram, the unigram and a uniform part; the mixture
weights depend on the bucket (binary logarithm) of how often the context was seen, and are learned by
expectation-maximisation on the counts of a held-out tenth of the training texts. A bucket that the held-out
texts never met takes the weights of the next lower bucket they met, or else of the next higher.

Counts never gather by document or by frequent word. Texts are read once into blocks of about
``BLOCK_TOKENS`` tokens: a written table that holds, for every block, its documents' tokens as indexes into
the block's own sorted list of word hashes. A block asks for the n-grams it has, each once with its count,
as packed sorted arrays, one for each hash shard; the shards add up what all blocks sent and answer in the
same order. What is shuffled are these arrays, so a word that is in every text costs one number a block. Every
shard has a task of its own, whose arrays hold what all blocks ask of it: the number of shards follows the number
of tokens, so that stays about ``SHARD_TOKENS`` tokens' worth and a few bytes for each block.

Defined edge cases: a null or empty text is one end token; without any training text every probability is
uniform over one outcome and the base is log10(1/1) = 0; rows with a null id are scored like others; a row for which
``learn`` is null does not train; repeated rows count repeatedly; an empty table gives no rows; columns other than the
named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._hashing import U64, mix, slices, text_buffers, word_hashes
from gridloom.llm._shared import fan_out, written

BLOCK_TOKENS = 2_500_000
SHARD_TOKENS = 2_000_000
BIGRAM_BITS = 56  # of a bigram's hash are sent; words keep 64
END = mix(np.array([0x1F2E3D4C5B6A7988], np.uint64))[0]
TRAIN, TUNE, TEST = 0, 1, 2
LEVELS = 12  # cells a decade in the held-out counts

_BLOCK = "block string, role int, n long, doc_ids binary, known binary, lengths binary, words binary, tokens binary"
_ASK = "shard int, block string, role int, kind int, hashes binary, counts binary"
_ANSWER = "block string, role int, kind int, shard int, total binary, main binary"


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers below 2**32, in the least width that holds them all."""
    top = int(x.max()) if len(x) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def _pack_sorted(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, low bytes together and high bytes together, which compresses."""
    d = np.diff(x, prepend=U64(0))
    return np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack_sorted(b: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    with np.errstate(over="ignore"):
        return np.cumsum(d.astype(np.uint64), dtype=np.uint64)


class _Gather:
    """Collects the documents of one role until a block is full."""

    def __init__(self, role: int):
        self.role, self.ids, self.nulls, self.lengths, self.parts, self.n = role, [], [], [], [], 0

    def row(self, name: str) -> dict:
        h = np.concatenate(self.parts)
        words, tokens = np.unique(h, return_inverse=True)
        return {
            "block": f"{name}-{self.role}",
            "role": self.role,
            "n": len(h),
            "doc_ids": np.array(self.ids, "<i8").tobytes(),
            "known": np.array(self.nulls, np.uint8).tobytes(),
            "lengths": _pack(np.array(self.lengths, np.int64)),
            "words": _pack_sorted(words),
            "tokens": _pack(tokens),
        }


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, serial = TaskContext.get().partitionId(), 0
    schema = pa.schema([("block", pa.string()), ("role", pa.int32()), ("n", pa.int64()), *((n, pa.binary()) for n in ("doc_ids", "known", "lengths", "words", "tokens"))])
    open_: dict[int, _Gather] = {}
    for whole in batches:
        for batch in slices(whole, 2):
            hashes, counts = word_hashes(*text_buffers(batch.column(2)), lower=True)
            ends = np.cumsum(counts)
            roles = batch.column(1).to_pylist()
            for i, (doc, role) in enumerate(zip(batch.column(0).to_pylist(), roles, strict=True)):
                g = open_.setdefault(role, _Gather(role))
                g.ids.append(0 if doc is None else doc)
                g.nulls.append(doc is not None)
                g.lengths.append(int(counts[i]) + 1)
                g.parts += [hashes[ends[i] - counts[i] : ends[i]], np.array([END])]
                g.n += int(counts[i]) + 1
                if g.n >= BLOCK_TOKENS:
                    yield pa.RecordBatch.from_pylist([open_.pop(role).row(f"{task}-{serial}")], schema)
                    serial += 1
    for role in sorted(open_):
        yield pa.RecordBatch.from_pylist([open_[role].row(f"{task}-{serial}")], schema)
        serial += 1


def blocks(docs: DataFrame, role: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), role.cast("int").alias("role"), F.col(text).alias("text"))
    return written(rows.mapInArrow(_block_batches, _BLOCK), "lm-blocks")


class _Block:
    """One row of the block table, opened: tokens, their bigrams, and both as lists without repeats."""

    def __init__(self, row: dict):
        self.words = _unpack_sorted(row["words"])
        self.tokens = _unpack(row["tokens"])
        self.lengths = _unpack(row["lengths"])
        self.starts = np.cumsum(self.lengths) - self.lengths
        v = len(self.words)
        context = np.empty_like(self.tokens)  # index v: the begin of a text
        context[1:] = self.tokens[:-1]
        context[self.starts] = v
        keys, self.bigram_of = np.unique(context * (v + 1) + self.tokens, return_inverse=True)
        self.left, self.right = keys // (v + 1), keys % (v + 1)
        with np.errstate(over="ignore"):
            heads = np.append(self.words, END)
            h = mix(heads[self.left] * U64(0xC2B2AE3D27D4EB4F) + self.words[self.right]) & ~U64((1 << (64 - BIGRAM_BITS)) - 1)
        self.bigrams, first = np.unique(h, return_inverse=True)
        self.bigram_of = first[self.bigram_of]
        self.pair_at = np.zeros(len(self.bigrams), np.int64)
        self.pair_at[first] = np.arange(len(first))
        self.left, self.right = self.left[self.pair_at], self.right[self.pair_at]


def _cuts(h: np.ndarray, shards: int) -> np.ndarray:
    """Where each hash shard starts and ends in a sorted array."""
    edges = [(i << 64) // shards for i in range(1, shards)]
    return np.concatenate([[0], np.searchsorted(h, np.array(edges, np.uint64)), [len(h)]])


def asks(table: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("block", pa.string()), ("role", pa.int32()), ("kind", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = _Block(row)
                for kind, h, at in ((1, b.words, b.tokens), (2, b.bigrams, b.bigram_of)):
                    n = np.bincount(at, minlength=len(h)) if row["role"] != TEST else np.zeros(len(h), np.int64)
                    cut = _cuts(h, shards)
                    out = [
                        {"shard": s, "block": row["block"], "role": row["role"], "kind": kind, "hashes": _pack_sorted(h[lo:hi]), "counts": _pack(n[lo:hi])}
                        for s, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True))
                        if hi > lo
                    ]
                    yield pa.RecordBatch.from_pylist(out, schema)

    return table.mapInArrow(run, _ASK)


def _answer_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up one shard's asks; each gets its n-grams' counts over all training texts, and over those not held out."""
    shard, heads, lists, numbers = None, {1: [], 2: []}, {1: [], 2: []}, {1: [], 2: []}
    for batch in batches:
        for i in range(batch.num_rows):
            shard, block, role, kind, hashes, counts = (batch.column(j)[i].as_py() for j in range(6))
            heads[kind].append((block, role))
            lists[kind].append(_unpack_sorted(hashes))
            numbers[kind].append(counts if role != TEST else b"")
    schema = pa.schema([("block", pa.string()), ("role", pa.int32()), ("kind", pa.int32()), ("shard", pa.int32()), ("total", pa.binary()), ("main", pa.binary())])
    for kind in (1, 2):
        if not lists[kind]:
            continue
        every = np.unique(np.concatenate(lists[kind]))
        total, main = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        for (_, role), h, n in zip(heads[kind], lists[kind], numbers[kind], strict=True):
            if role != TEST:
                at = np.searchsorted(every, h)
                total[at] += _unpack(n)
                if role == TRAIN:
                    main[at] += _unpack(n)
        out, held = [], 0
        for (block, role), h in zip(heads[kind], lists[kind], strict=True):
            at = np.searchsorted(every, h)
            out.append({"block": block, "role": role, "kind": kind, "shard": shard, "total": _pack(total[at]), "main": _pack(main[at]) if role == TUNE else b""})
            held += len(h)
            if held > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
        if kind == 1:  # the vocabulary's size and tokens, as a row of no block
            stats = np.array([np.count_nonzero(total), total.sum(), np.count_nonzero(main), main.sum()], np.int64)
            out.append({"block": None, "role": -1, "kind": 0, "shard": shard, "total": stats.tobytes(), "main": b""})
        yield pa.RecordBatch.from_pylist(out, schema)


def _joined(rows: pa.Table, field: str) -> tuple[dict, np.ndarray, np.ndarray]:
    """A block's own row and the answers to its words and bigrams in hash order."""
    items = rows.to_pylist()
    own = next(r for r in items if r["tokens"] is not None)
    parts: dict[int, list] = {1: [], 2: []}
    for r in sorted((r for r in items if r["tokens"] is None), key=lambda r: r["shard"]):
        parts[r["kind"]].append(_unpack(r[field]))
    return own, *(np.concatenate(parts[k]) if parts[k] else np.zeros(0, np.int64) for k in (1, 2))


def _estimates(b: _Block, words: np.ndarray, pairs: np.ndarray, n: int, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each different bigram of a block: bucket of its context, bigram and unigram estimates."""
    context = np.append(words, starts)[b.left]
    bucket = np.zeros(len(context), np.int64)
    seen = context > 0
    bucket[seen] = 1 + np.log2(context[seen]).astype(np.int64)
    p2 = np.divide(pairs, context, out=np.zeros(len(context)), where=seen)
    p1 = words[b.right] / max(n, 1)
    return bucket, np.minimum(p2, 1.0), p1


def _level(p: np.ndarray) -> np.ndarray:
    """0 for nothing, else one of LEVELS cells a decade."""
    out = np.zeros(len(p), np.int64)
    some = p > 0
    out[some] = 1 + np.floor(-np.log10(p[some]) * LEVELS).astype(np.int64)
    return out


def _value(level: np.ndarray) -> np.ndarray:
    return np.where(level == 0, 0.0, 10.0 ** (-(level - 0.5) / LEVELS))


def _together(table: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with their answers; the rows of one block meet, and no more than a block's size does.

    There are more partitions than blocks, so that few blocks share a task.
    """
    tasks = fan_out(table.sparkSession, 4 * table.count(), 1)
    return table.unionByName(answers.where(F.col("block").isNotNull()), allowMissingColumns=True).repartition(tasks, "block").groupBy("block")


def held_out_cells(table: DataFrame, answers: DataFrame, n: int, starts: int) -> DataFrame:
    """(bucket, p2, p1, n): the held-out tokens counted by context bucket and by level of the two estimates."""

    def run(rows: pa.Table) -> pa.Table:
        own, words, pairs = _joined(rows, "main")
        b = _Block(own)
        bucket, p2, p1 = _estimates(b, words, pairs, n, starts)
        times = np.bincount(b.bigram_of, minlength=len(bucket))
        cells, at = np.unique(np.stack([bucket, _level(p2), _level(p1)]), axis=1, return_inverse=True)
        sums = np.bincount(at.ravel(), weights=times, minlength=cells.shape[1]).astype(np.int64)
        return pa.table({"bucket": cells[0], "p2": cells[1], "p1": cells[2], "n": sums})

    tune = F.col("role") == TUNE
    got = _together(table.where(tune), answers.where(tune)).applyInArrow(run, "bucket long, p2 long, p1 long, n long")
    return got.groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n"))


def learn_weights(cells: np.ndarray, uniform: float, rounds: int = 60) -> dict[int, tuple[float, float, float]]:
    """EM for each context bucket over its held-out cells (rows of bucket, level 2, level 1, n)."""
    out = {}
    for bucket in np.unique(cells[:, 0]) if len(cells) else ():
        own = cells[cells[:, 0] == bucket]
        p = np.stack([_value(own[:, 1]), _value(own[:, 2]), np.full(len(own), uniform)])
        n = own[:, 3].astype(float)
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = w[:, None] * p
            share = share / share.sum(axis=0)
            w = (share * n).sum(axis=1) + 0.01  # a hundredth of a token, so that no weight is nothing
            w = w / w.sum()
        out[int(bucket)] = tuple(w.tolist())
    return out


def bucket_weights(learned: dict[int, tuple[float, float, float]], top: int, fallback: tuple[float, float, float]) -> np.ndarray:
    """Weights of the buckets 0 to ``top``: learned, else of the next lower learned bucket, else of the next higher.

    In bucket 0 no bigram was seen, so weights borrowed there leave the bigram out; ``fallback`` is for nothing learned.
    """
    if not learned:
        return np.array([fallback] * (top + 1))
    known = sorted(learned)
    out = np.array([learned[max((b for b in known if b <= k), default=known[0])] for k in range(top + 1)])
    if 0 not in learned:
        out[0, 0] = 0.0
        out[0] /= out[0].sum()
    return out


def score(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens, n_known, train_tokens, base_score, score. ``learn``: which rows train."""
    tuning = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("tune")), F.lit(10)) == 0
    role = F.when(~F.coalesce(learn, F.lit(False)), F.lit(TEST)).when(tuning, F.lit(TUNE)).otherwise(TRAIN)
    table = blocks(docs, role, doc_id, text)
    tokens = table.agg(F.sum("n")).first()[0] or 0
    shards = fan_out(docs.sparkSession, tokens, SHARD_TOKENS)
    answers = written(asks(table, shards).repartitionById(shards, "shard").mapInArrow(_answer_batches, _ANSWER), "lm-answers")
    v, n, v_main, n_main = np.sum([np.frombuffer(r[0], np.int64) for r in answers.where("kind = 0").select("total").collect()] or [np.zeros(4, np.int64)], axis=0).tolist()
    ends = _text_counts(table)
    cells = held_out_cells(table, answers, n_main, ends[TRAIN])
    cells = np.array([tuple(r) for r in cells.collect()], np.int64).reshape(-1, 4)  # at most levels squared a bucket
    weights = learn_weights(cells, 1.0 / (v_main + 1))
    texts = ends[TRAIN] + ends[TUNE]
    fallback = (0.0, 0.9, 0.1) if n else (0.0, 0.0, 1.0)

    def run(rows: pa.Table) -> pa.Table:
        own, words, pairs = _joined(rows, "total")
        b = _Block(own)
        bucket, p2, p1 = _estimates(b, words, pairs, n, texts)
        w = bucket_weights(weights, int(bucket.max(initial=0)), fallback)
        p = w[bucket, 0] * p2 + w[bucket, 1] * p1 + w[bucket, 2] / (v + 1)
        logs = np.log10(p)[b.bigram_of]
        base = np.log10((words + 1.0) / (n + v + 1.0))[b.tokens]
        known = (words > 0)[b.tokens].astype(np.int64)
        at = b.starts
        ids = np.frombuffer(own["doc_ids"], "<i8")
        bare = np.frombuffer(own["known"], np.uint8) == 0
        total = np.full(len(ids), n, np.int64)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=bare),
                "n_tokens": pa.array(b.lengths, pa.int64()),
                "n_known": pa.array(np.add.reduceat(known, at), pa.int64()),
                "train_tokens": pa.array(total),
                "base_score": pa.array(np.add.reduceat(base, at), pa.float64()),
                "score": pa.array(np.add.reduceat(logs, at), pa.float64()),
            }
        )

    return _together(table, answers).applyInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _text_counts(table: DataFrame) -> list[int]:
    """Texts by role; each is also one begin of a text."""
    got = {r[0]: int(r[1]) for r in table.groupBy("role").agg(F.sum(F.octet_length("doc_ids") / 8)).collect()}
    return [got.get(k, 0) for k in (TRAIN, TUNE, TEST)]
