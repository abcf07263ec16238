"""The corpus pipeline: toxicity, exact and near duplicates, benchmark passages, then token sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and decides by document;
rows with a null doc_id can't be named by a decision and stay, rows that repeat an id share its decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltwork.llm.common import cut, table
from siltwork.llm.decontamination import contaminated
from siltwork.llm.exact_dedup import exact_dedup
from siltwork.llm.minhash_dedup import near_components
from siltwork.llm.packing import best_fit_packing
from siltwork.llm.queries import tokenizer_files
from siltwork.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, by a lexicon learned from ``labels`` and these documents."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text the one with the largest id."""
    return docs.join(exact_dedup(docs).where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts linked at similarity 0.8 on five-word shingles the one with the smallest id."""
    return docs.join(near_components(docs).where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    hit = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048, one row per piece of a document."""
    return best_fit_packing(docs, *tokenizer_files())


STAGES = [
    ("toxicity", toxicity),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: Learned weights, MinHash, edit distance and tokenization aren't SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
