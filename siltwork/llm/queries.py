"""Queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .decontamination import contaminated
from .exact_dedup import OP9_SQL, exact_dedup
from .hard_negatives import hard_negatives, OP13_SQL
from .html_extraction import extract_text
from .language_id import language_id
from .line_dedup import OP3_SQL, drop_boilerplate
from .lm_scoring import lm_scores
from .merkle_manifest import merkle_manifest, OP11_SQL
from .minhash_dedup import near_components
from .packing import best_fit_packing
from .secrets import secret_scan
from .toxicity import toxicity
from .warc import OP2_SQL, revisit_report


def op1_minhash_dedup(spark, sf_dir):
    return near_components(table(spark, sf_dir, "documents"), k=2, percent=80)


def op2_warc_revisits(spark, sf_dir):
    return revisit_report(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark, sf_dir):
    return drop_boilerplate(table(spark, sf_dir, "documents"), F.col("source"))


def op4_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_files() -> tuple[str, str, str]:
    """Vocabulary, the same vocabulary as ranks, and its word pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_best_fit_packing(spark, sf_dir):
    return best_fit_packing(table(spark, sf_dir, "documents"), *tokenizer_files())


def op6_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secret_scan(spark, sf_dir):
    return secret_scan(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark, sf_dir):
    return merkle_manifest(table(spark, sf_dir, "documents"))


def op12_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_toxicity": op6_toxicity,
    "op7_secret_scan": op7_secret_scan,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_html_extraction": op10_html_extraction,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_language_id": op12_language_id,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL = {
    "op2_warc_revisits": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_hard_negatives": OP13_SQL,
}
