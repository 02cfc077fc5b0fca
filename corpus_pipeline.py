"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mixloom.llm import bpe, decontaminate, jaccard_join, line_dedup, toxicity
from mixloom.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; null and empty texts stay unless the bias alone rejects. Empty tables stay empty."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, model).where("predicted = 0").select(*docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; lines that stand on many sites go from all but their first place."""
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join one row stays, the one with the smallest doc_id; repeated rows count as copies, too."""
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none. Repeated rows share their fate."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents without text, with the number of tokens and digests of the ids and of their decoding.

    A null text is encoded as an empty one; every row, repeated or not, gives a row.
    """
    return bpe.encode(docs, ids=False, digests=True).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The first stage is a trained model: no SQL states it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
