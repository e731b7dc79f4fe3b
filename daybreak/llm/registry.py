"""The queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from daybreak.llm import chat, decontaminate, disclosure, inner_product, line_dedup, near_dedup, packing, prefix_trie, repeats, token_output, toxicity, vector_codes, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_output": token_output.op1_token_output,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_packing": packing.op3_packing,
        "op4_warc": warc.op4_warc,
        "op5_exact_topk": inner_product.op5_exact_topk,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_chat_format": chat.op7_chat_format,
        "op8_suffix_dedup": repeats.op8_suffix_dedup,
        "op9_decontamination": decontaminate.op9_decontamination,
        "op10_near_dedup": near_dedup.op10_near_dedup,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_disclosure": disclosure.op12_disclosure,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": warc.OP4_SQL, "op5_exact_topk": inner_product.OP5_SQL, "op9_decontamination": decontaminate.OP9_SQL, "op10_near_dedup": near_dedup.OP10_SQL, "op11_prefix_trie": prefix_trie.OP11_SQL, "op13_vector_codes": vector_codes.OP13_SQL}
