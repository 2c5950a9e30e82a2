"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuemill.llm import ann, bpe, html_text, lm, minhash, mixing, quality, suffix, topk, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": topk.op1_topk,
    "op2_suffix_dedup": suffix.op2_suffix_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_mixing": mixing.op5_mixing,
    "op6_ann": ann.op6_ann,
    "op7_html_text": html_text.op7_html_text,
    "op8_lm": lm.op8_lm,
    "op9_minhash": minhash.op9_minhash,
    "op10_quality": quality.op10_quality,
}
ORACLES: dict[str, str] = {"op1_topk": topk.OP1_SQL, "op9_minhash": minhash.OP9_SQL}
