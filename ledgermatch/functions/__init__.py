"""Column-level functions (JVM-side expressions unless stated otherwise)."""

from .amounts import parse_amount, cents_to_amount, amount_to_cents, format_fr_amount
from .dates import parse_date
from .text import (strip_accents, standardize_header, safe_lower, ktrim, text_lines,
                   is_entity_line, json_block)
from .similarity import levenshtein_score, partial_ratio, jaro_winkler

__all__ = [
    "parse_amount", "cents_to_amount", "amount_to_cents", "format_fr_amount", "parse_date",
    "strip_accents", "standardize_header", "safe_lower", "ktrim", "text_lines",
    "is_entity_line", "json_block", "levenshtein_score", "partial_ratio", "jaro_winkler",
]
