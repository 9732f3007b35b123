"""Invoice field heuristics over section text (F6-F13, A2), all built from
``regexp_extract`` / higher-order array functions: no Python in the loop.

The patterns are Java regexes, evaluated by Spark's own (Java) regex engine.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .amounts import amount_value, find_amount, parse_amount
from .dates import parse_date
from .text import is_entity_line, let, strip_accents, text_lines

# Invoice number patterns, tried in this order on the
# accent-folded text; the first that matches wins. Blank runs are possessive:
# what follows them is never a blank, so giving blanks back cannot help.
NUMBER_PATTERNS = [
    r"(?iu)facture\s*+(?:n[°o]|no|num(?:ero)?)?\s*+[:#-]?\s*+([a-z0-9\-_/]{3,})",
    r"(?iu)invoice\s*+(?:n[°o]|no|#)?\s*+[:#-]?\s*+([a-z0-9\-_/]{3,})",
    r"(?iu)\b(?:facture|invoice)\s*+[:#-]?\s*+([a-z0-9\-_/]{3,})",
]
NUMBER_STRIP = " :#-/"

# A labelled date, else the first date-looking token
# (on the lower-cased, accent-folded text).
DATE_LABELLED = (r"date\s*+(?:de\s*+facture|facture|invoice)?\s*+[:#-]?\s*+"
                 r"([0-9]{1,2}[\-/\.][0-9]{1,2}[\-/\.][0-9]{2,4}"
                 r"|[0-9]{4}[\-/\.][0-9]{1,2}[\-/\.][0-9]{1,2}|\d{1,2}\s\w+\s\d{4})")
DATE_ANY = r"(\d{1,2}[-/. ]\d{1,2}[-/. ]\d{2,4}|\d{4}[-/. ]\d{1,2}[-/. ]\d{1,2})"

# Total patterns (first hit of each, in order), then the
# largest amount-looking token of the text.
TOTAL_PATTERNS = [
    r"total\s*(?:ttc)?\s*[:#-]?\s*([+-]?\s*[0-9\s.,]+)",
    r"montant\s*(?:ttc|total)\s*[:#-]?\s*([+-]?\s*[0-9\s.,]+)",
]
AMOUNT_TOKEN = r"[+-]?\s*[\d\s.,]{2,}"

# Euro markers (lower-cased text).
CURRENCY_MARKERS = ["eur", "€", "euro", "euros"]
DEFAULT_CURRENCY = "EUR"

# Words that disqualify a customer line.
NOT_CUSTOMER_WORDS = ["facture", "reçu", "invoice"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def folded(text) -> Column:
    return strip_accents(_col(text))


def lowered(text) -> Column:
    return F.lower(strip_accents(_col(text)))


def find_invoice_number(folded_text) -> Column:
    """F6 on accent-folded text; separators trimmed from both ends."""
    def first(t, patterns):
        def found(g):
            hit = F.when(g != "", F.btrim(g, F.lit(NUMBER_STRIP)))
            return hit.otherwise(first(t, patterns[1:])) if patterns[1:] else hit
        return let(F.regexp_extract(t, patterns[0], 1), found)
    return let(let(_col(folded_text), lambda t: first(t, NUMBER_PATTERNS)), lambda hit: F.when(hit != "", hit))


def labelled_date(lowered_text) -> Column:
    """The token after a date label ('' when none)."""
    return F.regexp_extract(_col(lowered_text), DATE_LABELLED, 1)


def any_date(lowered_text) -> Column:
    """The first date-looking token ('' when none)."""
    return F.regexp_extract(_col(lowered_text), DATE_ANY, 1)


def find_invoice_date(lowered_text) -> Column:
    return F.coalesce(parse_date(labelled_date(lowered_text)), parse_date(any_date(lowered_text)))


def text_max_amount(lowered_text) -> Column:
    """A2: the largest amount-looking token of the text (whole text)."""
    tokens = F.regexp_extract_all(_col(lowered_text), F.lit(AMOUNT_TOKEN), 0)
    values = F.transform(F.transform(tokens, find_amount), amount_value)
    return F.array_max(F.filter(values, lambda x: x.isNotNull()))


def labelled_total(lowered_text, pattern: int) -> Column:
    """The token after a total label, by one of TOTAL_PATTERNS ('' when none)."""
    return F.regexp_extract(_col(lowered_text), TOTAL_PATTERNS[pattern], 1)


def find_total_amount(lowered_text) -> Column:
    t = _col(lowered_text)
    return F.coalesce(*[parse_amount(labelled_total(t, i)) for i in range(len(TOTAL_PATTERNS))],
                      text_max_amount(t))


def currency_detected(lowered_text) -> Column:
    t = _col(lowered_text)
    hit = F.lit(False)
    for m in CURRENCY_MARKERS:
        hit = hit | F.contains(t, F.lit(m))
    return hit


def find_currency(lowered_text) -> Column:
    """any euro marker -> EUR; the default is EUR as well."""
    return F.when(currency_detected(lowered_text), F.lit("EUR")).otherwise(F.lit(DEFAULT_CURRENCY))


def entity_flags(lines) -> Column:
    """``is_entity_line`` of every line, computed once per section."""
    return F.transform(_col(lines), is_entity_line)


def infer_supplier(lines, flags=None) -> Column:
    """first non-blank line that looks like an entity name."""
    flags = entity_flags(lines) if flags is None else _col(flags)
    return let(F.array_position(flags, True), lambda pos: F.when(pos > 0, F.get(_col(lines), (pos - 1).cast("int"))))


def infer_customer(lines, supplier, flags=None) -> Column:
    """from the second line on, an entity line that contains neither the
    supplier nor an invoice word."""
    flags = entity_flags(lines) if flags is None else _col(flags)
    pairs = F.zip_with(_col(lines), flags,
                       lambda l, e: F.struct(l.alias("l"), F.lower(l).alias("low"), e.alias("e")))

    def ok(sup, p, i):
        low = p["low"]
        cond = (i >= 1) & p["e"] & (sup.isNull() | ~F.contains(low, sup))
        for w in NOT_CUSTOMER_WORDS:
            cond = cond & ~F.contains(low, F.lit(w))
        return cond
    return let(F.lower(_col(supplier)), lambda sup: F.get(F.filter(pairs, lambda p, i: ok(sup, p, i)), 0)["l"])


def header_snippet(lines, n: int = 6) -> Column:
    """the first ``n`` non-blank lines joined by `` | ``."""
    return F.array_join(F.slice(_col(lines), 1, n), " | ")


def section_lines(text) -> Column:
    return text_lines(text)
