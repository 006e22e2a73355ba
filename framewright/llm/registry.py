"""The queries of this package and their SQL."""

from __future__ import annotations

from .bpe import op5_bpe
from .chat import OP1_SQL, op1_chat
from .embeddings import OP10_SQL, op10_vectors
from .language import op7_language
from .mixing import op8_mixing
from .quality_model import op9_quality
from .quality_rules import OP6_SQL, op6_rules
from .simhash import OP3_SQL, op3_simhash
from .suffix import OP2_SQL, op2_suffix
from .url_filter import OP4_SQL, op4_urls

QUERIES = {
    "op1_chat": op1_chat, "op2_suffix": op2_suffix, "op3_simhash": op3_simhash, "op4_urls": op4_urls, "op5_bpe": op5_bpe, "op6_rules": op6_rules,
    "op7_language": op7_language, "op8_mixing": op8_mixing, "op9_quality": op9_quality, "op10_vectors": op10_vectors,
}
ORACLES = {"op1_chat": OP1_SQL, "op2_suffix": OP2_SQL, "op3_simhash": OP3_SQL, "op4_urls": OP4_SQL, "op6_rules": OP6_SQL, "op10_vectors": OP10_SQL}
