"""
The corpus pipeline: toxicity, quality, near-duplicates, mixing, SentencePiece encoding.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
Tables that a stage needs besides (labels) are read from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripple.llm import common, mixing, pieces, quality_mil, simhash, toxicity

#: No stage but the mixing could be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _rows(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or of sentence scores is below 0.7. The model is fitted on labelled rows of ``docs``."""
    model = toxicity.fit_on(docs, common.table(spark, sf_dir, "labels"))
    return _rows(toxicity.score_documents(docs, model).where("predicted = 0"), docs)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention model scores 0.3 or more."""
    model = quality_mil.fit_on(docs, common.table(spark, sf_dir, "labels"))
    return _rows(quality_mil.score_documents(docs, model).where("predicted = 1"), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest doc_id; of repeated rows with that id, one."""
    return simhash.first_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document is returned as many times as it is taken (0, 1 or 2)."""
    got = mixing.fair_mix(docs, keep=docs.columns)
    return mixing.in_order(got, docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and the text decoded from them."""
    return pieces.encode_documents(docs, keep=("doc_id", "source")).select("row.doc_id", "row.source", "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near-duplicates", drop_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again, and what else it wrote there is removed."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = common.new_path(spark, f"stage-{name}")
        with common.scratch(spark):
            docs = common.written(stage(spark, docs, sf_dir), name, path=path)
    return STAGES[-1][1](spark, docs, sf_dir)
