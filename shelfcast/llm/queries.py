"""Registered queries of the operators: each reads whole tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfcast.llm import chat, decontaminate, manifest, mixing, near_duplicates, packing, pii, quality, secrets, substrings, topk, trie, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": quality.quality_scores,
    "op2_chat_format": chat.conversation_digests,
    "op3_decontamination": decontaminate.contamination,
    "op4_secret_scan": secrets.secret_digests,
    "op5_url_filter": urls.url_verdicts,
    "op6_substring_dedup": substrings.substring_digests,
    "op7_personal_data": pii.personal_data_digests,
    "op8_near_duplicates": near_duplicates.near_duplicate_classes,
    "op9_top_k_search": topk.nearest_vectors,
    "op10_mixing": mixing.mixture,
    "op11_packing": packing.packed_pieces,
    "op12_merkle_manifest": manifest.document_manifest,
    "op13_prefix_trie": trie.conversation_trie,
}
