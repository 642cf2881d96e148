"""The registered query of each operator, and the SQL that must give the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from termweave.llm import (
    op1_toxicity,
    op2_decontamination,
    op3_lines,
    op4_simhash,
    op5_language,
    op6_substrings,
    op7_mixing,
    op8_suffixes,
    op9_quality,
    op10_tokens,
    op11_lexical,
    op12_counts,
    op13_manifest,
    sql,
)
from termweave.llm.common import table
from termweave.storage import fresh_path


def op1_toxicity_scores(spark, sf_dir):
    return op1_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_benchmark_leaks(spark, sf_dir):
    return op2_decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash_components(spark, sf_dir):
    return op4_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    return op5_language.language(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark, sf_dir):
    return op6_substrings.dedup_substrings(table(spark, sf_dir, "documents"))


def op7_source_mix(spark, sf_dir):
    return op7_mixing.mix(table(spark, sf_dir, "documents"))


def op8_byte_dedup(spark, sf_dir):
    return op8_suffixes.dedup_bytes(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return op9_quality.quality(table(spark, sf_dir, "documents"))


def op10_token_files(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return op10_tokens.token_files(spark, table(spark, sf_dir, "documents"), path)


def op11_lexical_search(spark, sf_dir):
    return op11_lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_counts(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return op12_counts.count_tokens(table(spark, sf_dir, "documents"), path, fresh_path(spark, "token-counts"))


def op13_merkle_manifest(spark, sf_dir):
    return op13_manifest.manifest(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark, sf_dir):
    found = op3_lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity_scores,
        op2_benchmark_leaks,
        op3_line_dedup,
        op4_simhash_components,
        op5_language_id,
        op6_substring_dedup,
        op7_source_mix,
        op8_byte_dedup,
        op9_quality_rules,
        op10_token_files,
        op11_lexical_search,
        op12_token_counts,
        op13_merkle_manifest,
    )
}

#: The others need a trained model, a hash or bytes that SQL does not have.
SQL: dict[str, str] = {
    "op3_line_dedup": sql.LINES,
    "op6_substring_dedup": sql.SUBSTRINGS,
    "op7_source_mix": sql.MIX,
    "op9_quality_rules": sql.QUALITY,
    "op11_lexical_search": sql.LEXICAL,
    "op13_merkle_manifest": sql.MANIFEST,
}
