"""The corpus pipeline: stages that each call one operator of tessera.llm.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``.  Null texts count as empty and are judged like them; other
columns pass through; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, packing, pseudonyms, quality_model
from tessera.llm.common import Workspace, free_names
from tessera.llm.queries import PUBLIC_KEY, table, word_bpe


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on the labels of these documents, does not reject."""
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    return quality_model.score(docs.select(*own), model).filter("predicted = 1").select(*own)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by 0.8 of the five-word shingles, that of the smallest doc_id.

    Rows of one doc_id are one document, of which one row stays; rows without a
    doc_id have no place in a class and stay.
    """
    found = jaccard_join.jaccard_components(spark, docs.select("doc_id", "text"), n=5, percent=80)
    [stays] = free_names(docs.columns, "stays")
    stay = found.filter("doc_id = component_id").select(F.col("doc_id").alias(stays)).distinct()
    kept = docs.join(stay, F.col("doc_id") == F.col(stays), "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    leaks = decontaminate.find_leaks(spark, docs, table(spark, sf_dir, "benchmark"))
    [leaking] = free_names(docs.columns, "leaking")
    return docs.join(leaks.select(F.col("doc_id").alias(leaking)).distinct(), F.col("doc_id") == F.col(leaking), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data, and n_chars of the new texts."""
    changed = pseudonyms.pseudonymize(docs, PUBLIC_KEY, counts=None)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids."""
    return packing.pack(spark, docs, word_bpe())


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", pack)]

#: Model fitting and tokenizing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and reread by the next."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
