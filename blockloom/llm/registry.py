"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import sql
from .byte_bpe import op5_byte_bpe
from .decontaminate import op1_decontaminate
from .html_text import op6_html_text
from .jaccard_join import op4_jaccard_join
from .line_dedup import op8_line_dedup
from .quality_classifier import op7_quality_classifier
from .quality_rules import op9_quality_rules
from .secret_scan import op2_secret_scan
from .substring_dedup import op10_substring_dedup
from .url_filter import op3_url_filter

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_secret_scan": op2_secret_scan,
    "op3_url_filter": op3_url_filter,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_html_text": op6_html_text,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_substring_dedup": op10_substring_dedup,
}

SQL: dict[str, str] = {
    "op2_secret_scan": sql.SECRETS,
    "op3_url_filter": sql.URLS,
    "op4_jaccard_join": sql.JACCARD,
    "op8_line_dedup": sql.LINES,
    "op9_quality_rules": sql.RULES,
    "op10_substring_dedup": sql.SUBSTRINGS,
}
