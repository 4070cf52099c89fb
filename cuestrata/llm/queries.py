"""The registered queries of the operators, over their whole tables."""

from __future__ import annotations

import public_tokenizers

from cuestrata.llm.bpe import token_digests
from cuestrata.llm.codes import vector_codes
from cuestrata.llm.common import documents
from cuestrata.llm.decontaminate import leaks
from cuestrata.llm.fingerprints import edited_fingerprints
from cuestrata.llm.jaccard import jaccard_components
from cuestrata.llm.language import identify_languages
from cuestrata.llm.private import find_private
from cuestrata.llm.secrets import scan_secrets
from cuestrata.llm.sharding import assign_shards
from cuestrata.llm.substrings import dedup_words_digests
from cuestrata.llm.suffixes import dedup_bytes_digests
from cuestrata.llm.toxicity import score_toxicity
from cuestrata.llm.whitening import whitened_components

SHARDS = 40

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

QUERIES = {
    "op1_weak_supervision_toxicity": lambda spark, d: score_toxicity(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op2_super_kmer_dedup": lambda spark, d: dedup_words_digests(documents(spark, d)),
    "op3_bwt_merge_dedup": lambda spark, d: dedup_bytes_digests(documents(spark, d)),
    "op4_bitmap_queue_bpe": lambda spark, d: token_digests(documents(spark, d), RANKS),
    "op5_string_kernel_language": lambda spark, d: identify_languages(documents(spark, d)),
    "op6_virtual_slot_shards": lambda spark, d: assign_shards(documents(spark, d), SHARDS),
    "op7_simhash_leaks": lambda spark, d: leaks(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
    "op8_linked_secrets": lambda spark, d: scan_secrets(documents(spark, d)),
    "op9_rare_first_jaccard": lambda spark, d: jaccard_components(documents(spark, d), 3, 90),
    "op10_winnowed_fingerprints": lambda spark, d: edited_fingerprints(documents(spark, d)),
    "op11_boosted_private_data": lambda spark, d: find_private(documents(spark, d)),
    "op12_incremental_whitening": lambda spark, d: whitened_components(spark.read.parquet(f"{d}/embeddings.parquet")),
    "op13_laesa_vector_codes": lambda spark, d: vector_codes(spark.read.parquet(f"{d}/embeddings.parquet")),
}
SQL: dict[str, str] = {}
