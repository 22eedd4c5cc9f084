"""The corpus pipeline: stages over documents, each written and read again.

Language ID drops documents without a letter or with a hopeless score, line
dedup takes repeated lines out (and documents of which nothing is left), SimHash
near-dedup keeps one document of each group, and best-fit packing lays the rest
out in sequences. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultspark.llm import bestfit, langid_kernel, line_edit, near_sets, work


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of the model's floor or more.

    The model and its floor are learned from the documents of ``sf_dir`` that
    aren't held out."""
    model = langid_kernel.fit(work.read(spark, sf_dir, "documents"), floor=True)
    told = langid_kernel.predict(docs, model, carry=True)
    return told.where((F.col("lang_pred") != langid_kernel.UND) & (F.col("score") >= (model.floor if model else 0.0))).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines.

    A document that lost lines goes if it has no letter left."""
    done = line_edit.dedup_lines(docs)
    lost = F.col("_n_equal") + F.col("_n_near")
    stays = (lost == 0) | F.col("text").rlike(r"\p{L}")
    columns = [F.char_length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return done.where(stays).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of documents whose five-word
    shingles have a Jaccard similarity of 0.8 or more; rows without a doc_id stay."""
    groups = near_sets.near_groups(docs).select(F.col("doc_id").alias("_id"), "component_id")
    kept = groups.where(F.col("_id") == F.col("component_id")).select("_id").distinct()
    first = docs.join(kept, F.col("doc_id") == F.col("_id"), "left").where(F.col("_id").isNotNull() | F.col("doc_id").isNull())
    return first.select(*docs.columns)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bestfit.pack_documents(docs)


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("best-fit packing", best_fit)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next."""
    docs = work.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.cut(docs, f"stage{k}")
    return docs
