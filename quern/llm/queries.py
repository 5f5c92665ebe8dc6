"""The queries of this subpackage by name, and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, imatch, minhash, pii, prefix_trie, quality, substring_dedup, suffix_dedup, token_files, toxicity, url_filter, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_pii": pii.op2_pii,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_imatch": imatch.op4_imatch,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_byte_bpe": bpe.op7_byte_bpe,
        "op8_token_files": token_files.op8_token_files,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_minhash": minhash.op10_minhash,
        "op11_whitening": whitening.op11_whitening,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_quality": quality.op13_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_substring_dedup": substring_dedup.ORACLE_SQL,
        "op9_url_filter": url_filter.ORACLE_SQL,
        "op10_minhash": minhash.ORACLE_SQL,
        "op12_prefix_trie": prefix_trie.ORACLE_SQL,
    }
