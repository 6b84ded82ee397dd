"""Queries of the training-data operators and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .attention_lm import op6_attention_scores
from .common import table
from .decontaminate import op1_simhash_windows
from .html_consensus import op9_consensus_paths
from .media import op5_signature_sniffing
from .merkle import ORACLE_OP13, op13_merkle_manifest
from .near_dedup import op4_consistent_sampling
from .packing import op3_drr_packing
from .pigeonring import op11_pigeonring
from .quality_kn import op7_kneser_ney
from .resampling import ORACLE_OP12, op12_importance_resampling
from .shard_shuffle import op2_external_shuffle
from .token_store import op10_simple8b
from .url_cascade import ORACLE_OP8, op8_url_cascade

Query = Callable[[SparkSession, str], DataFrame]
BPE = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Query] = {
    "op1_simhash_windows": lambda s, d: op1_simhash_windows(table(s, d, "documents"), table(s, d, "benchmark")),
    "op2_external_shuffle": lambda s, d: op2_external_shuffle(table(s, d, "documents")),
    "op3_drr_packing": lambda s, d: op3_drr_packing(table(s, d, "documents"), BPE),
    "op4_consistent_sampling": lambda s, d: op4_consistent_sampling(table(s, d, "documents")),
    "op5_signature_sniffing": lambda s, d: op5_signature_sniffing(table(s, d, "documents")),
    "op6_attention_scores": lambda s, d: op6_attention_scores(table(s, d, "documents"), BPE),
    "op7_kneser_ney": lambda s, d: op7_kneser_ney(table(s, d, "documents"), table(s, d, "labels")),
    "op8_url_cascade": lambda s, d: op8_url_cascade(table(s, d, "pages")),
    "op9_consensus_paths": lambda s, d: op9_consensus_paths(table(s, d, "pages")),
    "op10_simple8b": lambda s, d: op10_simple8b(table(s, d, "documents"), BPE),
    "op11_pigeonring": lambda s, d: op11_pigeonring(table(s, d, "documents")),
    "op12_importance_resampling": lambda s, d: op12_importance_resampling(table(s, d, "documents"), table(s, d, "benchmark")),
    "op13_merkle_manifest": lambda s, d: op13_merkle_manifest(table(s, d, "documents")),
}

ORACLE: dict[str, str] = {"op8_url_cascade": ORACLE_OP8, "op12_importance_resampling": ORACLE_OP12, "op13_merkle_manifest": ORACLE_OP13}
