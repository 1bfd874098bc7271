"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from lorevine.llm.chat_format import OP4_SQL, op4_chat_format
from lorevine.llm.decontaminate import OP3_SQL, op3_decontamination
from lorevine.llm.language_id import op5_language_id
from lorevine.llm.mix_sources import OP6_SQL, op6_mix_sources
from lorevine.llm.parity_join import OP2_SQL, op2_jaccard_join
from lorevine.llm.secrets_scan import op10_secret_scan
from lorevine.llm.shard_slots import op9_virtual_slots
from lorevine.llm.spot_signatures import OP7_SQL, op7_spot_signatures
from lorevine.llm.token_counts import op1_token_counts
from lorevine.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_decontamination": op3_decontamination,
    "op4_chat_format": op4_chat_format,
    "op5_language_id": op5_language_id,
    "op6_mix_sources": op6_mix_sources,
    "op7_spot_signatures": op7_spot_signatures,
    "op8_toxicity": op8_toxicity,
    "op9_virtual_slots": op9_virtual_slots,
    "op10_secret_scan": op10_secret_scan,
}

ORACLE_SQL = {
    "op2_jaccard_join": OP2_SQL,
    "op3_decontamination": OP3_SQL,
    "op4_chat_format": OP4_SQL,
    "op6_mix_sources": OP6_SQL,
    "op7_spot_signatures": OP7_SQL,
}
