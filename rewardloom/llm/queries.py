"""One registered query per operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rewardloom.llm import alignment, chatparts, contamination, contentsort, fingerprint, language, merkle, mixture, packing, simhash, substring, tokenfile, warc
from rewardloom.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_prefix_fingerprints": lambda spark, folder: fingerprint.fingerprint_report(documents(spark, folder)),
    "op2_simhash_groups": lambda spark, folder: simhash.near_duplicates(documents(spark, folder)),
    "op3_source_mixing": lambda spark, folder: mixture.mix_report(documents(spark, folder)),
    "op4_token_shards": lambda spark, folder: tokenfile.token_report(documents(spark, folder)),
    "op5_automaton_dedup": lambda spark, folder: substring.remove_repeats(documents(spark, folder)),
    "op6_exact_dedup": lambda spark, folder: contentsort.duplicate_groups(documents(spark, folder)),
    "op7_chat_parts": lambda spark, folder: chatparts.chat_digest(spark.read.parquet(f"{folder}/conversations.parquet")),
    "op8_byte_language": lambda spark, folder: language.predict(documents(spark, folder)),
    "op9_best_fit_packing": lambda spark, folder: packing.pack(documents(spark, folder)),
    "op10_warc_derivatives": lambda spark, folder: warc.page_derivatives(spark.read.parquet(f"{folder}/pages.parquet")),
    "op11_merkle_manifest": lambda spark, folder: merkle.manifest_report(documents(spark, folder)),
    "op12_benchmark_contamination": lambda spark, folder: contamination.contamination_report(
        documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet")
    ),
    "op13_tokenizer_alignment": lambda spark, folder: alignment.align(documents(spark, folder)),
}

SQL: dict[str, str] = {
    "op3_source_mixing": mixture.MIX_SQL,
    "op6_exact_dedup": contentsort.DEDUP_SQL,
    "op7_chat_parts": chatparts.CHAT_SQL,
    "op11_merkle_manifest": merkle.MANIFEST_SQL,
    "op12_benchmark_contamination": contamination.CONTAMINATION_SQL,
}
