"""The queries of the operators in this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from docspark.llm.align import op13_tokenizer_alignment
from docspark.llm.bpe_count import op7_token_counts
from docspark.llm.decontaminate import OP10_SQL, op10_decontaminate
from docspark.llm.html_text import op1_html_text
from docspark.llm.langid import op4_language_id
from docspark.llm.minhash import op9_near_dedup
from docspark.llm.pieces import op6_sentencepiece
from docspark.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from docspark.llm.records import op8_token_records
from docspark.llm.rules import op11_quality_rules
from docspark.llm.simhash import op3_simhash
from docspark.llm.substrings import OP5_SQL, op5_substring_dedup
from docspark.llm.urls import OP2_SQL, op2_url_filter

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_url_filter": op2_url_filter,
    "op3_simhash": op3_simhash,
    "op4_language_id": op4_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_token_counts": op7_token_counts,
    "op8_token_records": op8_token_records,
    "op9_near_dedup": op9_near_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_quality_rules": op11_quality_rules,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}
SQL = {
    "op2_url_filter": OP2_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op10_decontaminate": OP10_SQL,
    "op12_prefix_trie": OP12_SQL,
}
