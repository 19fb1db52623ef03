"""The registered query of each operator, and its SQL where there is one."""

from __future__ import annotations

from .alignment import op12_token_alignment
from .chat import op6_format_chats
from .decontam import op10_decontaminate
from .mainline import op5_main_text
from .mixing import op1_mix_sources
from .neardup import op9_near_duplicates
from .personal import op13_personal_data
from .rules import op8_quality_rules
from .secretscan import op3_secret_scan
from .shards import op7_shards
from .substring import op4_substring_dedup
from .tokenpack import op2_token_ids
from .veccodes import op11_vector_codes

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_ids": op2_token_ids,
    "op3_secret_scan": op3_secret_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_main_text": op5_main_text,
    "op6_format_chats": op6_format_chats,
    "op7_shards": op7_shards,
    "op8_quality_rules": op8_quality_rules,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_decontaminate": op10_decontaminate,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_alignment": op12_token_alignment,
    "op13_personal_data": op13_personal_data,
}
ORACLES: dict[str, str] = {}
