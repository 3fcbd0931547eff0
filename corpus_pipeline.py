"""The corpus pipeline: documents in, packed pieces out, by five operators in turn.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs; each works on all that the stage before kept.

Defined results of every stage: null texts count as empty, and empty texts and texts of any length are whole texts like
others; of rows that are equal in all that a stage looks at, the first in input order stays; null doc_ids are rows like
others; an empty table gives an empty one. All stages but the last keep extra columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlinelake.llm import common, exact_dedup, minhash, packing, quality, suffix_dedup
from outlinelake.llm.common import discard, documents, materialise
from outlinelake.llm.queries import tokenizer
from outlinelake.llm.side_files import having


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labels of all of `documents`, less the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out())
    return quality.keep(docs, quality.train(documents(spark, sf_dir), labels))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    found = exact_dedup.dedup(docs, history=F.pmod(F.col("doc_id"), F.lit(2)) == 0)
    out = having(docs, found.where("kept"))
    discard(found)
    return out


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, of a similarity of 0.8 or more; fewer than 35 of 64 coordinates agree in about one pair in a million of 0.8."""
    found = minhash.near_duplicates(docs, percent=80, matches=35)
    out = having(docs, found.where("first"))
    discard(found)
    return out


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of repeated strings."""
    return suffix_dedup.clean(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), end=1)


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", apart), ("suffix_dedup", unrepeated), ("packing", packed)]

#: Near copies, the classifier and the tokenizer have no SQL; tests/llm/test_llm.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. A stage's documents, and whatever else it wrote, go when the next one's are stored."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        before, mark = docs, len(common.made)
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*common.made[mark:-1])  # the last is the stored result
        if k:
            discard(before)
    return docs
