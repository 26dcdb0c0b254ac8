"""Queries of this package and their SQL, as the entry point registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.llm.bpe import op2_bpe
from parley.llm.conversation_repair import op13_conversation_repair
from parley.llm.cover_tree import OP8_SQL, op8_topk
from parley.llm.filter_audit import OP12_SQL, op12_filter_audit
from parley.llm.katz import op6_katz
from parley.llm.mixing import OP7_SQL, op7_mixing
from parley.llm.multi_index import op11_multi_index
from parley.llm.quality import op3_quality
from parley.llm.simhash import op5_simhash
from parley.llm.suffix_dedup import op4_suffix_dedup
from parley.llm.token_output import op1_token_output
from parley.llm.toxicity import op10_toxicity
from parley.llm.url_filter import OP9_SQL, op9_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_simhash": op5_simhash,
    "op6_katz": op6_katz,
    "op7_mixing": op7_mixing,
    "op8_topk": op8_topk,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_multi_index": op11_multi_index,
    "op12_filter_audit": op12_filter_audit,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op7_mixing": OP7_SQL,
    "op8_topk": OP8_SQL,
    "op9_url_filter": OP9_SQL,
    "op12_filter_audit": OP12_SQL,
}
