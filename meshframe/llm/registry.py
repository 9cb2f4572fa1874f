"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from meshframe.llm.alignment import op13_alignment
from meshframe.llm.bpe import op5_byte_bpe
from meshframe.llm.embeddings import OP1_SQL, op1_embedding_dedup
from meshframe.llm.minhash import OP10_SQL, op10_near_dedup
from meshframe.llm.mixing import OP2_SQL, op2_mixing
from meshframe.llm.pieces import op12_sentencepiece
from meshframe.llm.pii import op6_pii
from meshframe.llm.quality import op9_quality
from meshframe.llm.sharding import op8_sharding
from meshframe.llm.substring import OP4_SQL, op4_substring_dedup
from meshframe.llm.tokens import op3_token_count
from meshframe.llm.trie import OP11_SQL, op11_prefix_trie
from meshframe.llm.url_filter import OP7_SQL, op7_url_filter

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_mixing": op2_mixing,
    "op3_token_count": op3_token_count,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_pii": op6_pii,
    "op7_url_filter": op7_url_filter,
    "op8_sharding": op8_sharding,
    "op9_quality": op9_quality,
    "op10_near_dedup": op10_near_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_alignment": op13_alignment,
}
ORACLE = {
    "op1_embedding_dedup": OP1_SQL,
    "op2_mixing": OP2_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op7_url_filter": OP7_SQL,
    "op10_near_dedup": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
}
