"""Queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

from quadrille.llm.chat import op8_chat
from quadrille.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from quadrille.llm.html import op10_main_text
from quadrille.llm.langid import op5_langid
from quadrille.llm.mixing import op4_mix
from quadrille.llm.packing import op3_pack
from quadrille.llm.quality import op9_quality
from quadrille.llm.simhash import op6_simhash
from quadrille.llm.tokenbin import op7_token_ids
from quadrille.llm.warc import OP1_SQL, op1_warc

QUERIES = {f.__name__: f for f in (op1_warc, op2_exact_dedup, op3_pack, op4_mix, op5_langid, op6_simhash, op7_token_ids, op8_chat, op9_quality, op10_main_text)}
ORACLES = {"op1_warc": OP1_SQL, "op2_exact_dedup": OP2_SQL}
