"""Registered queries of this subpackage, and their SQL where SQL can express them.

The others are checked in ``tests/llm`` against brute force, round trips or held-out labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqforge.llm import alignment, ann, counts, langid, mixing, negatives, packing, repair, secrets, simhash, substring, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    simhash.op1_simhash_dedup, langid.op2_language_id, repair.op3_token_ids, substring.op4_substring_dedup,
    ann.op5_nearest_neighbours, mixing.op6_mix_sources, secrets.op7_secret_scan, topk.op8_top_inner_products,
    packing.op9_pack, toxicity.op10_toxicity, alignment.op11_token_alignment, counts.op12_token_counts, negatives.op13_hard_negatives)}

ORACLE: dict[str, str] = {
    "op4_substring_dedup": substring.OP4_SQL, "op5_nearest_neighbours": ann.OP5_SQL,
    "op6_mix_sources": mixing.OP6_SQL, "op8_top_inner_products": topk.OP8_SQL,
    "op13_hard_negatives": negatives.OP13_SQL}
