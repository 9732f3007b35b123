"""Money parsing and formatting.

Amounts are decimal(18,2) everywhere; the matching join works on integral
cents so that tolerance tests are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DecimalType

from .text import let

AMOUNT_TYPE = DecimalType(18, 2)

# Fixed values. One amount grammar for every input (invoice text, statement
# cells, statement lines, model answers): optional sign, then either a
# grouped integer (groups of three after space, dot or comma) or plain
# digits, then an optional decimal part of one or two digits. No-break space
# and narrow no-break space count as spaces. Blanks are only looked for after
# a sign and are never given back, so a run of blanks costs one pass.
_SP = r"[\s\u00a0\u202f]"
GROUPED = r"(?:\d{1,3}(?:[ .,\u00a0\u202f]\d{3})+(?!\d)|\d+)"
AMOUNT_PATTERN = r"(?:[+-]" + _SP + r"*+)?" + GROUPED + r"(?:[.,](?:\d{1,2})(?!\d))?"
_DECIMALS = r"[.,](\d{1,2})$"
# A number as programs write it: digits with one dot, or an exponent. One to
# three digits, a dot and three digits are a grouped integer instead, as people
# write them (``1.234`` is 1234), unless the first digit is a zero (``0.125``).
_PLAIN = (r"^[+-]?(?![1-9]\d{0,2}\.\d{3}$)"
          r"(?:\d*\.\d+|\d+\.?\d*[eE][+-]?\d{1,2}|\d*\.\d+[eE][+-]?\d{1,2})$")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_amount(text) -> Column:
    """First amount found in ``text`` as decimal(18,2); NULL if none.

    ``1 234,56``, ``1.234,56``, ``1,234.56`` and ``1234,56`` all give 1234.56;
    a single decimal digit is tenths (``12.5`` -> 12.50). A text that is
    nothing but a plain or scientific number with one dot (``0.125``,
    ``12345678.9``, ``1.0E7``) is that number, rounded half up; ``1.234`` is a
    grouped 1234. What is a number by type (a numeric cell, a JSON number) goes
    through ``number_amount`` and keeps its dot.

    One regex search finds the amount; its value is all of its digits
    divided by 10^(number of decimal digits), negated when it carries a minus.
    """
    def parsed(c):
        bare = F.trim(c)
        # blank cells, most of the debit and credit columns, are not searched
        return F.when(bare == "", F.lit(None).cast(AMOUNT_TYPE)) \
            .when(F.rlike(bare, F.lit(_PLAIN)), number_amount(bare)).otherwise(let(find_amount(c), amount_value))
    return let(_col(text), parsed)


def number_amount(number) -> Column:
    """A numeric value as decimal(18,2), rounded half up; NULL out of range."""
    return F.round(_col(number).try_cast("decimal(38,8)"), 2).try_cast(AMOUNT_TYPE)


def find_amount(text) -> Column:
    """The first amount-shaped substring of ``text`` ('' when none)."""
    return F.regexp_extract(_col(text), AMOUNT_PATTERN, 0)


def amount_value(found) -> Column:
    """Value of a string found by ``find_amount``."""
    found = _col(found)
    digits = F.regexp_replace(found, r"[^0-9]", "").try_cast("decimal(20,0)")
    scale = F.length(F.regexp_extract(found, _DECIMALS, 1))
    value = (digits / F.when(scale == 2, F.lit(100)).when(scale == 1, F.lit(10)).otherwise(F.lit(1)))
    signed = F.when(F.contains(found, F.lit("-")), -value).otherwise(value)
    return signed.try_cast(AMOUNT_TYPE)


def amount_to_cents(amount) -> Column:
    """decimal amount -> bigint cents (exact for scale <= 2)."""
    return (_col(amount) * 100).cast("bigint")


def cents_to_amount(cents) -> Column:
    return (_col(cents).cast("decimal(20,0)") / 100).cast(AMOUNT_TYPE)


def format_fr_amount(amount) -> Column:
    """French rendering: ``-1 234,56`` (space groups, comma decimals)."""
    return F.translate(F.format_number(_col(amount), 2), ",.", " ,")


def format_en_amount(amount) -> Column:
    """English rendering: ``-1,234.56``."""
    return F.format_number(_col(amount), 2)
