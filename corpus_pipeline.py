"""A corpus pipeline: five operators, one after the other, over all documents.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landstream.llm import decontamination, language_id, mixing, ngram_join, suffix_dedup
from landstream.llm.common import marked, table, written

#: Documents whose language is told with less than this go; those without a letter have no language.
LEAST_SURE = 0.4


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those whose language can't be told; if there is no model to tell it, only the former."""
    model = language_id.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = language_id.identify_language(docs, model)
    return told.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SURE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays; a null doc_id is in no group."""
    groups = ngram_join.ngram_components(docs.select("doc_id", "text"))
    copies = written(groups.where("doc_id != component_id").select("doc_id").distinct(), "copies")
    told = marked(docs, "doc_id", copies)  # most documents surely stay, and needn't be shuffled for the join
    return told.where("NOT __maybe").unionByName(told.where("__maybe").join(copies, "doc_id", "left_anti")).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated long strings out of the texts; no document goes. n_chars follows the text."""
    left = suffix_dedup.remove_repeats(docs)
    return left.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit documents so that the sources come near their target weights; `copy` numbers a document's copies."""
    return mixing.emitted(docs)


STAGES = [
    ("language identification", tell_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("mixing to target weights", mix),
]

#: The stages learn a model and compare texts by edits, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i}")
    return docs
