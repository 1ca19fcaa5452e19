"""The corpus pipeline: quality, near duplicates, personal data, mixing, token ids.

STAGES are applied in order to the documents table; each result is written to the shared folder and read again as the
next one's input; what no later stage reads is deleted. All stages but the last return the columns of documents, further ones
included, whatever their names. Any column may hold nulls, texts may be of any length, and empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, jaccard_join, mixing, pii, quality
from tidemark.llm.common import drop_stored, free_name, stored

#: SQL can't express these stages; tests/llm/test_pipeline.py holds each stage and run() against a plain version.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking, learned from the labels, doesn't reject.

    Null and empty texts and repeated rows are judged like all others, so equal texts stay or go together. Where no label
    can be learned from, all stay.
    """
    model, name = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), free_name(docs.columns, "quality_score")
    return quality.score(docs, model, name=name).where(F.col(name) >= quality.CUT).drop(name)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id, then the least digest of the text.

    Null and empty texts are copies of each other, and like nothing else. Of repeated rows one stays.
    """
    return jaccard_join.one_of_each(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data; n_chars follows, where the table has it. Null texts stay null; repeated rows stay equal."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them; a null source is one of its own, null texts have size 0."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and n_tokens of every document; null and empty texts have no ids. Repeated rows stay apart."""
    return bpe.encode(docs, bpe.default_path(), keep=["doc_id", "source"]).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality", keep_good), ("near duplicates", keep_one_of_each), ("personal data", sanitise), ("mixing", mix), ("encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, f"pipeline-{name.replace(' ', '-')}")
            if before is not None:
                drop_stored(before)
            before = docs
    return docs
