"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, packing.

Each stage is given the documents that the stage before it kept, and all but the last return the columns of documents:
what a stage decides is missing or changed in its result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, linededup, packing, simhash
from tidemark.llm._text import new_name, shared_folder

#: A document whose best language has less than this share of its words' probability is rejected.
LEAST_SCORE = 0.5


def _own(docs: DataFrame, out: DataFrame) -> DataFrame:
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter and one dominant language; the labels of these documents train the model.

    Null and letterless texts go.  Without any label, nothing can be learned and only these go.
    """
    model = language.fit(docs)
    if not model["names"]:
        return docs.where(F.col("text").rlike("\\p{L}"))
    label, score = new_name("label", docs), new_name("score", docs)
    out = language.predict(docs, model, label, score)
    return _own(docs, out.where((F.col(label) != language.UNKNOWN) & (F.col(score) >= LEAST_SCORE)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs of eight words or more; documents that lose every word go."""
    return linededup.drop_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group linked at a similarity of 0.8 of five-word shingles."""
    return simhash.drop_similar(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark phrase."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document left, with their place in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("benchmark", benchmark), ("packing", pack)]

#: SQL cannot express the model; tests compare the stages with brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this run wrote, wherever Spark's file systems hold it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet to the shared folder and read again by the next, which is when the one before it goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    written = None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if written:
            _delete(spark, written)
        written = f"{folder}/{k}-{name}"
    return docs
