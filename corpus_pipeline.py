"""From raw documents to packed training sequences: five stages, each written to the shared folder and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore.llm.common import small_batches
from runlore.llm.languages import UNDETERMINED, fit, identify
from runlore.llm.mixing import mixed_rows
from runlore.llm.ngram_join import one_of_each
from runlore.llm.packing import pack_documents
from runlore.llm.quality import learn, scored
from runlore.session import materialise, remove_table, ship_package

#: A document goes if its language is undetermined or no language is likelier than all others together.
LEAST_LANGUAGE_SCORE = 0.5
#: A document goes if its quality score is lower.
LEAST_QUALITY = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told from their words, learned from all that name one. Without any such document
    there is nothing to tell languages apart by, and all stay that have a letter."""
    ship_package(spark)
    small_batches(spark)
    if docs.where("lang IS NOT NULL AND text IS NOT NULL").isEmpty():
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = docs.withColumn("_found", identify(docs, fit(docs)))
    told = (F.col("_found.lang_pred") != UNDETERMINED) & (F.col("_found.score") >= LEAST_LANGUAGE_SCORE)
    return found.where(told).drop("_found")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones, doesn't reject. Without labels all stay."""
    ship_package(spark)
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    if labels.where("quality IS NOT NULL").isEmpty():
        return docs
    return docs.withColumn("_score", scored(docs, learn(docs, labels))).where(F.col("_score") >= LEAST_QUALITY).drop("_score")


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    ship_package(spark)
    small_batches(spark)
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in token sequences."""
    ship_package(spark)
    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality", quality),
    ("ngram_join", ngram_join),
    ("mixing", mixing),
    ("packing", packing),
]

#: Classifiers and the tokenizer are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        remove_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)
