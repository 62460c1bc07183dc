"""Queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from graphloom.llm.audio_fingerprint import op3_audio_fingerprint
from graphloom.llm.chat_format import OP5_SQL, op5_chat_format
from graphloom.llm.decontaminate import op9_decontamination
from graphloom.llm.filter_audit import OP11_SQL, op11_filter_audit
from graphloom.llm.language_id import op13_language_id
from graphloom.llm.line_dedup import op4_line_dedup
from graphloom.llm.ngram_jaccard import OP1_SQL, op1_ngram_jaccard
from graphloom.llm.packing import op10_packing
from graphloom.llm.secret_scan import op7_secret_scan
from graphloom.llm.sharding import op8_sharding
from graphloom.llm.spelling import OP12_SQL, op12_spelling
from graphloom.llm.toxicity import op2_toxicity
from graphloom.llm.url_filter import op6_url_filter

QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_toxicity, op3_audio_fingerprint, op4_line_dedup, op5_chat_format, op6_url_filter, op7_secret_scan, op8_sharding, op9_decontamination, op10_packing, op11_filter_audit, op12_spelling, op13_language_id)}

ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard": OP1_SQL, "op5_chat_format": OP5_SQL, "op11_filter_audit": OP11_SQL, "op12_spelling": OP12_SQL}
