"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from cadenza.llm.byte_bpe import op12_byte_bpe
from cadenza.llm.common import Query
from cadenza.llm.decontamination import op9_decontamination
from cadenza.llm.html import op2_html
from cadenza.llm.language import op10_language
from cadenza.llm.merkle import OP11_SQL, op11_merkle
from cadenza.llm.neardup_vectors import OP6_SQL, op6_vectors
from cadenza.llm.pieces import op8_pieces
from cadenza.llm.quality import op1_quality
from cadenza.llm.secrets import OP5_SQL, op5_secrets
from cadenza.llm.simhash import op4_simhash
from cadenza.llm.toxicity import op3_toxicity
from cadenza.llm.warc import OP7_SQL, op7_warc
from cadenza.llm.whitening import op13_whitening

QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_html": op2_html,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_secrets": op5_secrets,
    "op6_vectors": op6_vectors,
    "op7_warc": op7_warc,
    "op8_pieces": op8_pieces,
    "op9_decontamination": op9_decontamination,
    "op10_language": op10_language,
    "op11_merkle": op11_merkle,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_whitening": op13_whitening,
}

SQL: dict[str, str] = {
    "op5_secrets": OP5_SQL,
    "op6_vectors": OP6_SQL,
    "op7_warc": OP7_SQL,
    "op11_merkle": OP11_SQL,
}
