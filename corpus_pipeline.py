"""The corpus pipeline: each stage calls one operator on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result
as Parquet in the shared folder and reads it again as the next stage's documents.  Only
the columns of ``documents`` pass between stages, whatever else the input carries.

Ids are meant to be unique.  Rows that share one are judged together where a stage says
so: they are kept by the language stage if one of them is, the near-duplicate stage keeps
the different texts of an id that leads a class, and the decontamination stage drops all
rows of an id in one of which an item is found.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import byte_bpe, decontaminate, jaccard, language, pii
from tracelake.llm.common import Workspace, broadcast_if_small, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _except(docs: DataFrame, exceptions: DataFrame, workspace: Workspace, *names: str) -> DataFrame:
    """Documents with the columns of the few exceptional ids; null elsewhere.  Ids may be null or repeat."""
    staged = workspace.keep("exceptions", exceptions.select(F.col("doc_id").alias("_id"), *names))
    return docs.join(broadcast_if_small(staged), docs["doc_id"].eqNullSafe(staged["_id"]), "left").drop("_id")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language and set ``lang`` to the one found where it differs.

    Rows without letters (null and empty texts too) and rows that no language explains go.
    Rows that repeat an id are kept if one of them is, with the least language found.
    """
    docs, workspace = _documents(docs), Workspace(spark, "stage-language")
    found = language.identify(language.from_documents(docs), workspace)
    by_id = found.groupBy("doc_id").agg(
        F.max("kept").alias("_kept"), F.min(F.when(F.col("kept"), F.col("language"))).alias("_lang"),
        F.min(F.coalesce("declared", F.lit(""))).alias("low"), F.max(F.coalesce("declared", F.lit(""))).alias("high"),
    )
    odd = by_id.where(~F.col("_kept") | (F.col("low") != F.col("_lang")) | (F.col("high") != F.col("_lang")))
    told = _except(docs, odd, workspace, "_kept", "_lang")
    return told.where(F.coalesce("_kept", F.lit(True))).withColumn("lang", F.coalesce("_lang", "lang")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of five-word-shingle sets linked at a Jaccard of 0.8 or more.

    The one with the class's least id stays.  Rows equal in id and text are one document;
    other texts under an id that leads a class stay with it.
    """
    docs, workspace = _documents(docs), Workspace(spark, "stage-jaccard")
    found = workspace.keep("classes", jaccard.classes(docs, workspace))
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("_lead"))
    told = _except(docs, repeated.where((F.col("rows") > 1) | ~F.col("_lead")), workspace, "_lead")
    once = told.where(F.col("_lead").isNull())
    again = told.where(F.col("_lead")).dropDuplicates(["doc_id", "text"])
    return once.unionByName(again).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark item is found, with all rows of the same id."""
    docs, workspace = _documents(docs), Workspace(spark, "stage-decontaminate")
    leaks = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"), workspace)
    leaking = leaks.groupBy("doc_id").agg(F.lit(True).alias("_leak"))
    return _except(docs, leaking, workspace, "_leak").where(F.col("_leak").isNull()).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; ``n_chars`` follows the new text."""
    found = pii.find(_documents(docs), Workspace(spark, "stage-pii"), carry=COLUMNS)
    text = pii.redacted(F.coalesce("text", F.lit("")), F.concat("base", "added"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each text, decode it again, and return counts and digests per document."""
    return byte_bpe.round_trip(_documents(docs), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("bpe", bpe),
]

#: Neither the fitted stages nor byte-pair encoding can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last stage."""
    workspace = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = workspace.keep(name, stage(spark, docs, sf_dir))
    return docs
