"""Language identification by compression: the language whose raw-content dictionary makes a text smallest.

Training takes a bounded sample of the labelled texts: all of them are cut into pieces of ``PIECE`` characters, and
of each language the ``SAMPLE_PIECES`` pieces with the least hash are taken, wherever in a text they stand. That is at
most 160,000 characters a language. Which are taken depends on the texts alone, so reruns agree.

A text is reduced to lower-case words and read as a ring, in blocks of ``RING`` bytes until every byte was read: the
last block is filled up from the text's beginning, which costs a match or two. Each block is compressed with each
language's zstandard dictionary, by one setting for every length.

The margin is how much larger the second best result is. A text whose margin is narrow is marked
``rejected``; it still has the best language in ``lang_pred``.

Defined edge cases: ``und`` with score 0 for a null text and for one without a letter, and for every text if
nothing could be learned; ties go to the first language in code-point order; rows whose lang or text is null
are not learned from; equal texts of one language are learned from once; columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_PIECES = 80
PIECE = 2_000
RING = 4_096
_LETTER = regex.compile(r"\p{L}").search
_LETTERS = regex.compile(r"\p{L}+").findall


def train(docs: DataFrame, chosen: Column, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Raw dictionary content by language, from rows where ``chosen`` holds."""
    rows = docs.where(chosen & F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    pieces = F.explode(F.sequence(F.lit(0), F.floor((F.char_length(text) - 1) / PIECE).cast("int")))
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"), pieces.alias("i"))
    rows = rows.withColumn("at", F.shiftrightunsigned(F.xxhash64("h", "i"), 24))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct("at", 0.03)).collect()}  # one row a language
    if not counts:
        return {}
    bound = F.lit(0)
    for name, n in counts.items():  # a hash bound that half as many again as the wanted pieces stay below
        bound = F.when(F.col("lang") == name, F.lit(min(1 << 40, int((1.5 * SAMPLE_PIECES + 30) / n * (1 << 40))))).otherwise(bound)
    least = rows.where(F.col("at") < bound).select("lang", "at", F.expr(f"substring(text, i * {PIECE} + 1, {PIECE})").alias("part"))
    found: dict[str, list] = {}
    for r in least.groupBy("lang", "at").agg(F.min("part").alias("part")).collect():  # some 150 short rows a language
        found.setdefault(r["lang"], []).append((r["at"], r["part"]))
    return {k: "".join(plain(x[1]) for x in sorted(v)[:SAMPLE_PIECES]).encode() for k, v in sorted(found.items())}


def plain(text: str) -> str:
    """Lower-case letters with single spaces for all else, one at either end: what is compressed."""
    return " " + " ".join(_LETTERS(text.lower())) + " "


def ring(body: bytes, size: int = RING) -> list[bytes]:
    """Blocks of ``size`` bytes that hold every byte of ``body``, the last filled up from its beginning."""
    whole = -(-len(body) // size) * size
    body = (body * (whole // len(body) + 1))[:whole]
    return [body[i : i + size] for i in range(0, whole, size)]


class Compressors:
    """One compressor a language. Matches are short, as a dictionary's words are."""

    def __init__(self, content: dict[str, bytes]):
        self.names = sorted(content)
        bare = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        setting = zstandard.ZstdCompressionParameters.from_level(5, min_match=4, strategy=zstandard.STRATEGY_LAZY, search_log=2, **bare)
        self.own = []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=setting)
            self.own.append(zstandard.ZstdCompressor(dict_data=d, compression_params=setting))

    def sizes(self, text: str) -> list[int]:
        blocks = ring(plain(text).encode())
        return [sum(len(c.compress(x)) for x in blocks) for c in self.own]


def identify(docs: DataFrame, content: dict[str, bytes], doc_id: str = "doc_id", text: str = "text", narrow: float = 0.01) -> DataFrame:
    """One row a document: doc_id, lang_pred, score, margin, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(content)  # at most 160,000 characters a language
    schema = "doc_id long, lang_pred string, score double, margin double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Compressors(shared.value)
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                if not own.names or x is None or not _LETTER(x):
                    out.append(("und", 0.0, 0.0, True))
                    continue
                sizes = np.array(own.sizes(x), float)
                best = int(sizes.argmin())
                lead = np.delete(sizes, best)
                margin = float((lead.min() - sizes[best]) / sizes[best]) if len(lead) else 1.0
                score = float(1.0 / np.exp(np.clip((sizes[best] - sizes) / 4.0, -50, 0)).sum())
                out.append((own.names[best], score, margin, margin < narrow))
            cols = zip(*out, strict=True) if out else [[]] * 4
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "lang_pred", "score", "margin", "rejected"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
