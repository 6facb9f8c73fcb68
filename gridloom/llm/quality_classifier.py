"""Quality classification by regularised quadratic discriminant analysis of document statistics.

Each text is reduced to a few transformed statistics. The two classes get a mean and a covariance of them,
shrunk towards the pooled covariance and towards its diagonal; a text's score is the logistic of the
difference of the two Gaussian log densities, taken as Mahalanobis distances by cached Cholesky factors,
plus the log prior ratio, divided by a temperature that offsets the dependence among the statistics.

Training uses all labelled rows that may be learned from, by sums that combine before they are shuffled: one
matrix of products a class and task, whatever the size of the table.

Defined edge cases: null and empty texts have the statistics of no words and get a score like any other; a
class without training rows makes every score the share of label 1 (0.5 without labels); several labels of
one document count once, the least; rows with a null label do not train; repeated documents train and are scored
repeatedly; columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._hashing import slices, text_buffers, word_hashes
from gridloom.llm._shared import written

STATISTICS = (
    "words", "bytes_a_word", "symbols", "capitals", "digits", "marks", "exclamations", "distinct_words",
    "repeated_triples", "words_a_line", "repeated_lines", "compression", "entropy", "beyond_ascii",
)
SHRINK_POOLED = 0.1
SHRINK_DIAGONAL = 0.05
TEMPERATURE = 2.0


def _kinds() -> np.ndarray:
    """For each byte: bit 0 symbol, 1 capital, 2 digit, 3 other mark, 4 exclamation, 5 beyond ASCII, 6 letter."""
    out = np.zeros(256, np.uint8)
    for c in range(256):
        x = chr(c)
        out[c] = (
            (x in "#*$%&|<>") << 0 | x.isascii() * x.isupper() << 1 | x.isascii() * x.isdigit() << 2
            | (33 <= c < 127 and not x.isalnum() and x not in "#*$%&|<>!") << 3 | (x == "!") << 4 | (c >= 128) << 5 | x.isascii() * x.isalpha() << 6
        )
    return out


_KINDS = _kinds()


def _log1p_share(a: float, b: float) -> float:
    return float(np.log1p(20.0 * a / b)) if b else 0.0


def statistics(data: np.ndarray, words: np.ndarray, packer: zstandard.ZstdCompressor) -> list[float]:
    """The STATISTICS of one text, from its bytes and word hashes."""
    n, size = len(words), len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    seen = np.bincount(data, minlength=256)
    of = lambda bit: int(seen[(_KINDS >> bit) & 1 == 1].sum())
    p = seen[seen > 0] / size
    triples = words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(5) + words[2:] * np.uint64(7) if n > 2 else words[:0]
    body = data.tobytes()
    lines = [x for x in body.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)),
        float(np.log(size / n)),
        _log1p_share(of(0), n),
        _log1p_share(of(1), of(6) + 1),
        _log1p_share(of(2), size),
        _log1p_share(of(3), n),
        _log1p_share(of(4), n),
        float(np.log(len(np.unique(words)) / n) / max(1.0, np.log(n))),
        _log1p_share(len(triples) - len(np.unique(triples)), len(triples)),
        float(np.log(n / max(1, len(lines)))),
        _log1p_share(len(lines) - len(set(lines)), len(lines)),
        float(np.log(len(packer.compress(body)) / size)),
        float(-(p * np.log2(p)).sum()),
        _log1p_share(of(5), size),
    ]


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table (doc_id, x): one scan of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1, write_checksum=False)
        old = np.seterr(over="ignore")
        for whole in batches:
            for batch in slices(whole, 1):
                data, offsets = text_buffers(batch.column(1))
                words, counts = word_hashes(data, offsets)
                ends = np.cumsum(counts)
                x = [statistics(data[offsets[i] : offsets[i + 1]], words[ends[i] - counts[i] : ends[i]], packer) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])
        np.seterr(**old)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, x array<double>"), "statistics")


class Discriminant:
    """Means, Cholesky factors and log determinants of two classes."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray):
        d = sums.shape[1]
        self.prior = float((counts[1] + 1e-9) / (counts.sum() + 2e-9))
        self.fitted = bool((counts > 1).all())
        if not self.fitted:
            return
        self.means = sums / counts[:, None]
        own = [squares[c] / counts[c] - np.outer(self.means[c], self.means[c]) for c in (0, 1)]
        pooled = (own[0] * counts[0] + own[1] * counts[1]) / counts.sum()
        flat = np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        # few rows of a class lean more on what both have
        lean = [SHRINK_POOLED + (1 - SHRINK_POOLED) * d / (d + c) for c in counts]
        mixed = [(1 - a) * s + a * pooled for a, s in zip(lean, own, strict=True)]
        mixed = [(1 - SHRINK_DIAGONAL) * s + SHRINK_DIAGONAL * flat for s in mixed]
        self.factors = [np.linalg.cholesky(s) for s in mixed]
        self.whiten = [np.linalg.inv(f) for f in self.factors]  # kept, so that scoring a batch is one product
        self.log_det = [2 * float(np.log(np.diag(f)).sum()) for f in self.factors]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability-like score of label 1 for each row of x."""
        if not self.fitted:
            return np.full(len(x), self.prior)
        density = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.whiten[c].T
            density.append(-0.5 * ((z * z).sum(axis=1) + self.log_det[c]))
        odds = (density[1] - density[0]) / TEMPERATURE + np.log(self.prior / (1 - self.prior))
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -60, 60)))


def fit(stats: DataFrame, labels: DataFrame, chosen: Column, doc_id: str = "doc_id", label: str = "quality") -> Discriminant:
    """Learn from the rows of ``labels`` where ``chosen`` holds (a Column over doc_id)."""
    marks = labels.where(F.col(label).isin(0, 1) & chosen).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).alias("label"))
    rows = stats.join(marks, "doc_id").select(F.col("label").cast("int").alias("label"), "x")
    d = len(STATISTICS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d, d))
        for batch in batches:
            if batch.num_rows:
                y = np.column_stack([np.ones(batch.num_rows), np.stack(batch.column(1).to_numpy(zero_copy_only=False))])
                mark = batch.column(0).to_numpy()
                for c in (0, 1):
                    total[c] += y[mark == c].T @ y[mark == c]
        cell = np.arange(total.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel())], names=["cell", "v"])

    total = np.zeros(2 * d * d)
    for r in rows.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():  # 2 d d rows
        total[r["cell"]] = r["v"]
    total = total.reshape(2, d, d)
    return Discriminant(total[:, 0, 0], total[:, 0, 1:], total[:, 1:, 1:])


def classify(stats: DataFrame, model: Discriminant, threshold: float = 0.7) -> DataFrame:
    """One row a document: doc_id, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
                s = model.score(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, score double, predicted int")
