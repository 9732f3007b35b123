"""Statement text lines -> transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.amounts import parse_amount
from ..functions.dates import parse_date
from ..functions.text import let, trim_ends
from ..operators.once import evaluate_once

_B = r"[\s\p{Z}]"
# Fixed value: a statement line starts with a numeric date.
HEAD_PATTERN = rf"^{_B}*+(\d{{1,2}}[\-/]\d{{1,2}}[\-/]\d{{2,4}}){_B}++(.*)$"
# The amount that ends a line, in the grammar of ``functions.amounts``, on the
# reversed line: decimals, groups of three from the right, sign. Anchored, and
# each step back gives up one group, so a line costs one pass. The longest
# amount after a blank is taken, so digits that end the description are not.
TAIL_PATTERN = (rf"^{_B}*+((?:\d{{1,2}}[.,])?+(?:(?:\d{{3}}[ .,\u00a0\u202f])+\d{{1,3}}(?!\d)|\d++)"
                rf"(?:{_B}?[+-])?)(?={_B})")
# Separates the parts for a split; a noncharacter, never in text.
_MARK = "\ufdd0"


def parse_statement_lines(lines: DataFrame, line_col: str = "line", id_col: str = "statement_id",
                          no_col: str = "line_no") -> DataFrame:
    """Trimmed non-blank lines that start with a date and end with an amount
    -> (statement_id, row_idx, date, description, amount); other lines are
    skipped."""
    # the amount from the right end, then the date from the left of what remains
    base = evaluate_once(lines.select(F.col(id_col).alias("statement_id"),
                                      F.col(no_col).cast("long").alias("row_idx"), line_col),
                         {"_tail": F.split(F.regexp_replace(F.reverse(F.col(line_col)), TAIL_PATTERN, f"{_MARK}$1{_MARK}"), _MARK)})
    head = F.split(F.regexp_replace(F.reverse(F.col("_tail")[2]), HEAD_PATTERN, f"$1{_MARK}$2"), _MARK)
    base = evaluate_once(base.where(F.size("_tail") == 3), {"_head": head}).where(F.size("_head") == 2)
    parsed = evaluate_once(base, {
        "date": parse_date(F.col("_head")[0]),
        "description": let(F.col("_head")[1], trim_ends),
        "amount": parse_amount(F.reverse(F.col("_tail")[1]))})
    return parsed.where(F.col("date").isNotNull() & F.col("amount").isNotNull()) \
        .select("statement_id", "row_idx", "date", "description", "amount")
