"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm.bpe_automaton import op7_bpe_automaton
from tessera.llm.chat_format import OP10_SQL, op10_chat_format
from tessera.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from tessera.llm.packing import op1_packing
from tessera.llm.quality_model import op2_quality_model
from tessera.llm.quality_rules import op3_quality_rules
from tessera.llm.simhash import op9_simhash
from tessera.llm.substring_dedup import OP8_SQL, op8_substring_dedup
from tessera.llm.token_files import op6_token_files
from tessera.llm.toxicity import op4_toxicity

QUERIES = {f.__name__: f for f in (op1_packing, op2_quality_model, op3_quality_rules, op4_toxicity, op5_exact_dedup, op6_token_files, op7_bpe_automaton, op8_substring_dedup, op9_simhash, op10_chat_format)}
SQL = {"op5_exact_dedup": OP5_SQL, "op8_substring_dedup": OP8_SQL, "op10_chat_format": OP10_SQL}
