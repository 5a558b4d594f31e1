"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm.audit import OP13_SQL, op13_filter_audit
from tidemark.llm.chat import OP11_SQL, op11_chat_formatting
from tidemark.llm.decontaminate import OP3_SQL, op3_decontaminate
from tidemark.llm.fingerprint import op7_fingerprints
from tidemark.llm.language import op6_language_id
from tidemark.llm.licenses import OP4_SQL, op4_license_scan
from tidemark.llm.lines import OP10_SQL, op10_line_dedup
from tidemark.llm.minhash import OP5_SQL, op5_minhash_dedup
from tidemark.llm.passages import op2_substring_dedup
from tidemark.llm.periodic import op12_periodic_runs
from tidemark.llm.pieces import op1_sentencepiece
from tidemark.llm.tokens import op9_token_output
from tidemark.llm.urls import OP8_SQL, op8_url_filters

QUERIES = {
    "op10_line_dedup": op10_line_dedup,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_filter_audit": op13_filter_audit,
    "op1_sentencepiece": op1_sentencepiece,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_license_scan": op4_license_scan,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_language_id": op6_language_id,
    "op7_fingerprints": op7_fingerprints,
    "op8_url_filters": op8_url_filters,
    "op9_token_output": op9_token_output,
}
ORACLE_SQL = {"op4_license_scan": OP4_SQL, "op5_minhash_dedup": OP5_SQL, "op3_decontaminate": OP3_SQL, "op10_line_dedup": OP10_SQL, "op8_url_filters": OP8_SQL, "op11_chat_formatting": OP11_SQL, "op13_filter_audit": OP13_SQL}
