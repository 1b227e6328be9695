"""The training-data pipeline: stages over ``documents``, each calling one operator of ``fairgauge.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet
and reread as the next stage's docs. All but the last return the columns of ``documents``. Rows with null ids, texts or
sources pass through like any others; an empty table gives an empty result; columns beyond those of ``documents`` are
left out."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairgauge.llm import classifier, mixing, packing, pii, simhash
from fairgauge.llm.common import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on ``labels``, expects to be of the best grade."""
    labels = table(spark, sf_dir, "labels")
    graded = labels.select("doc_id", classifier.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    docs = docs.select(*COLUMNS)
    return classifier.classify(docs, classifier.train(docs, graded)).where("kept").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (3-word shingles, 2 bits): the one of smallest id, then text."""
    return simhash.representatives(docs.select(*COLUMNS))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the kind's name in brackets; ``n_chars`` follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed_rows(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces with their token ids."""
    return packing.pack(docs)


STAGES = [("quality", good_documents), ("near_duplicates", one_of_each_group), ("pii", redact_pii),
          ("mix", mix_sources), ("pack", pack)]

#: A fitted classifier and a tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
