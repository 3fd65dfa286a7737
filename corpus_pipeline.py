"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.llm import bpe, line_dedup, mixing, near_dedup, quality_rules
from lethe.llm.common import materialize, table


def _recounted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as its texts are now."""
    return docs.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns])


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base limits and the learned list let pass."""
    return quality_rules.filter_quality(docs, table(spark, sf_dir, "labels"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat earlier ones."""
    return _recounted(line_dedup.dedup_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup.keep_one(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: documents as often as the mix takes them, in training order."""
    return _recounted(mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stream in tokens: doc_id, lang, source, ids, n_tokens, and digests of the ids and of their decoded text."""
    coded = bpe.recode_column(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", "ids", *bpe.digest_columns())


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_to_targets),
    ("bpe", encode),
]

#: SQL can't express the learned rules, the signatures or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents; what a stage keeps is written as a table before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
