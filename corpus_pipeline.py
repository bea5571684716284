"""The corpus pipeline: documents through five stages, each a table in the shared folder that the next one reads."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annolytics.llm import decontaminate, jaccard, line_quality, mixing, toxicity
from annolytics.llm.common import scratch, stored

ORACLE_SQL = None  # scores of a trained model and random rounding have no SQL


def _documents(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*like.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without lines that too many texts of their source share."""
    return _documents(line_quality.judge(docs, clean=True).where("kept"), docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labelled rows of the stage's input, does not find toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _documents(toxicity.score(docs, model).where("predicted = 0"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles link at a similarity of 0.8."""
    return _documents(jaccard.one_of_each(docs, n=5, percent=80), docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return _documents(decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target asks for."""
    return mixing.mix(docs)


STAGES = [("quality rules", quality_rules), ("toxicity", toxic_documents), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", benchmark_leaks), ("mixing sources to target weights", source_mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again. Rows that two documents share stay two."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return docs
