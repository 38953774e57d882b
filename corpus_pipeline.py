"""A training corpus from `documents`, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of `documents`; n_chars follows the text.

Defined cases, for every stage: an empty table gives no rows; extra columns, of
any name, are kept up to the last stage; rows that repeat whole are judged alike,
and one of them stays in `one_of_each_group`; ids may be null or repeat. The
others are in each stage's docstring.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, language, nearjoin, packing, suffixes
from quarry.llm.common import prepare
from quarry.sources.tables import table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the models learn from the labels of three quarters of the input.

    Null texts and texts without a letter go; without a single label nothing can be told, and all go.
    """
    return language.known(docs, docs.where(~language.held_out(F.col("doc_id"))))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least id, then of the least digest. Documents without words all stay."""
    return nearjoin.distinct(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long strings that occur elsewhere too; null texts and those of which nothing but blanks is left go."""
    cut = suffixes.trim(docs, suffixes.LENGTH, suffixes.GRAM)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).where("text IS NOT NULL AND trim(text) <> ''")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark of any weight. Null texts and texts without words hold none; with an empty benchmark all stay."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences; null texts are empty, and long ones are cut."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("best_fit_packing", packed),
]

#: No stage's method can be put in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, with what lies between them in the checkpoint folder."""
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
