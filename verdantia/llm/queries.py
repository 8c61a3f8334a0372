"""The queries opN_<name> and their oracle SQL, where SQL can express them."""

from __future__ import annotations

from . import decontaminate, jaccard_join, quality_rules, url_reputation
from .byte_bpe import op1_byte_bpe
from .decontaminate import op4_decontamination
from .html_text import op7_html_text
from .jaccard_join import op5_jaccard_join
from .language_id import op10_language_id
from .language_model import op3_language_model
from .quality_rules import op8_quality_rules
from .suffix_dedup import op6_suffix_dedup
from .token_store import op9_token_store
from .url_reputation import op2_url_reputation

QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_url_reputation,
        op3_language_model,
        op4_decontamination,
        op5_jaccard_join,
        op6_suffix_dedup,
        op7_html_text,
        op8_quality_rules,
        op9_token_store,
        op10_language_id,
    )
}
ORACLE: dict[str, str] = {
    "op2_url_reputation": url_reputation.ORACLE,
    "op4_decontamination": decontaminate.ORACLE,
    "op5_jaccard_join": jaccard_join.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
}
