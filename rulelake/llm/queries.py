"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bradley_terry, chat, compaction, decontam, minhash, mixing, telephony, token_records, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pareto_mixing": mixing.op1_pareto_mixing,
    "op2_telephony": telephony.op2_telephony,
    "op3_size_tiered": compaction.op3_size_tiered,
    "op4_chunked_warc": warc.op4_chunked_warc,
    "op5_circulant_minhash": minhash.op5_circulant_minhash,
    "op6_token_records": token_records.op6_token_records,
    "op7_lexicon_toxicity": toxicity.op7_lexicon_toxicity,
    "op8_prefix_decontamination": decontam.op8_prefix_decontamination,
    "op9_bradley_terry_quality": bradley_terry.op9_bradley_terry_quality,
    "op10_chat_parts": chat.op10_chat_parts,
}

#: Where SQL can't express a query (learned models, audio, tokens) tests hold it against brute force or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op1_pareto_mixing": mixing.OP1_SQL,
    "op3_size_tiered": compaction.OP3_SQL,
    "op4_chunked_warc": warc.OP4_SQL,
    "op5_circulant_minhash": minhash.OP5_SQL,
    "op8_prefix_decontamination": decontam.OP8_SQL,
    "op10_chat_parts": chat.OP10_SQL,
}
