"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing and encoding, one written table after each.

The filtering stages drop rows and change nothing else. Every verdict holds for its row, by a row key, since ids
may be null or repeated: of a group of copies one row stays. The mixing stage replaces each document by the
words the mix takes from it, one row for each pass. The last stage encodes and decodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import byte_bpe, exact_dedup, mixing, near_dedup, quality_rules
from gridloom.llm._shared import clear, few, keyed, tables_written, written
from gridloom.llm.queries import bpe_vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEY = "row_key"  # of a stage's input, where ids may be null or repeated


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_filter(docs, carry=COLUMNS, complete=False)  # the rules include the base ones
    return judged.where("kept").select("carried.*")


def _without(docs: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    return docs.join(few(written(dropped.where("NOT kept").select(KEY), name)), KEY, "left_anti").select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = keyed(docs.select(*COLUMNS), KEY, "to-exact")
    return _without(docs, exact_dedup.exact_dedup(docs, row=KEY), "copies")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = keyed(docs.select(*COLUMNS), KEY, "to-near")
    return _without(docs, near_dedup.near_dedup(docs, row=KEY), "near-copies")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = keyed(docs.select(*COLUMNS), KEY, "to-mix")
    return mixing.mixed_texts(docs, mixing.mix(docs, weights=(1, 2, 3), row=KEY), row=KEY)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs, *bpe_vocabulary()).drop("lossless")


STAGES = [
    ("quality_rules", rules_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", encoding_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Of the tables written on the way only the last stage's input stays, which it reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = tables_written()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        clear(spark, keep=1, since=mark)
    return STAGES[-1][1](spark, docs, sf_dir)
