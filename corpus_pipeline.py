"""A training corpus from raw documents, in five stages."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitus.llm.decontaminate import decontaminated
from habitus.llm.jaccard_join import one_of_each
from habitus.llm.mixing import mix
from habitus.llm.queries import fold
from habitus.llm.secrets import mask_secrets
from habitus.llm.tables import shared_folder, table, written
from habitus.llm.toxicity import toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not predict as toxic."""
    labels = table(spark, sf_dir, "labels")
    _, model = toxicity(docs, labels, fold("doc_id", 4) != 2, written)
    marked = model.with_evidence(docs, name="__evidence")
    return marked.filter(model.score(F.col("__evidence")) < 0.3).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of exact and near copies."""
    return one_of_each(docs, written)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), written)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and ``n_chars`` counted anew."""
    masked = mask_secrets(docs, written)
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of sources takes."""
    return mix(docs, written)[0]


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard", without_near_copies),
    ("decontamination", without_benchmark),
    ("secret_scans", without_secrets),
    ("mixing", mixed),
]
#: The stages learn models and draw pseudorandom numbers, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each result written as Parquet and read again."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
