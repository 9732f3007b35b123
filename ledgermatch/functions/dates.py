"""Date parsing (F2): day-first numeric dates, ISO dates, and dates with
French or English month names. Invalid calendar days give NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import fold_latin1, let, trim_ends

# Month names after accent folding and lower-casing,
# French then English, full and abbreviated.
MONTHS = {
    "janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6,
    "juillet": 7, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12,
    "janv": 1, "fevr": 2, "fev": 2, "avr": 4, "juil": 7, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9,
}

# Weekdays that may stand before a date with a month name,
# French then English, full and abbreviated ("mar", a month too, is left out).
WEEKDAYS = ["lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche", "lun", "mer", "jeu", "ven", "sam", "dim",
            "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
            "mon", "tue", "tues", "wed", "thu", "thur", "thurs", "fri", "sat", "sun"]

# Numeric shapes: day-first (05/01/2024, 5-1-24, 05.01.2024) or ISO
# year-first, both with an optional time (after a blank or T) and offset; a
# four-digit first number means year-first. Eight digits are yyyyMMdd.
# Month-name shapes: "15 janvier 2023", "15-Jan-2024", "1er mai 2024",
# "Jan 15, 2023" (rewritten to day-month-year first), also after a weekday
# ("Monday 5 February 2024", "lundi, le 5 février 2024").
_NUM = (r"^(\d{1,4})[-/. ](\d{1,2})[-/. ](\d{1,4})"
        r"(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?: ?(?:Z|[+-]\d{2}:?\d{2}))?)?$")
_COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
_WEEKDAY = rf"^(?:{'|'.join(WEEKDAYS)})(?:\.?,?\s++|,)(?:le\s++|the\s++)?"
_MONTH_D_Y = r"^([a-z]+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})$"
_D_MONTH_Y = r"^(\d{1,2})(?:er)?[\s-]+([a-z]+)\.?,?[\s-]+(\d{4}|\d{2})$"


def _month_map() -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in MONTHS.items()) + ")")


def parse_date(text) -> Column:
    """Parse a date token to DateType; NULL when it is not a full, valid
    date. Two-digit years are 20yy.

    Numeric dates (the common case) cost three anchored extracts; only the
    rows that are not numeric are lower-cased and accent-folded for the
    month-name shapes."""
    c = F.col(text) if isinstance(text, str) else text
    shapes = let(let(c, trim_ends), lambda s: let(F.struct(s.alias("s"), *[F.regexp_extract(s, _NUM, i).alias(n) for i, n in enumerate("abz", 1)]), _ymd))
    return shapes.try_cast("date")  # always year-month-day here; a cast takes a fraction of a pattern's time


def _ymd(parts: Column) -> Column:
    s, a, b, z = (parts[n] for n in "sabz")
    year_first = (F.length(a) == 4) & (F.length(z) <= 2)
    day_first = (F.length(a).between(1, 2)) & F.length(z).isin(2, 4)
    named = F.regexp_replace(F.regexp_replace(F.lower(fold_latin1(s)), _WEEKDAY, ""), _MONTH_D_Y, "$2 $1 $3")

    def by_month(t):
        nd, nm, ny = (F.regexp_extract(t, _D_MONTH_Y, i) for i in (1, 2, 3))
        ny = F.when(F.length(ny) == 2, F.concat(F.lit("20"), ny)).otherwise(ny)
        return F.concat(ny, F.lit("-"), F.try_element_at(_month_map(), nm), F.lit("-"), nd)  # NULL without a month
    compact = F.regexp_replace(s, _COMPACT, "$1-$2-$3")
    return (F.when(year_first, F.concat_ws("-", a, b, z))
            .when(day_first, F.concat_ws("-", F.when(F.length(z) == 2, F.concat(F.lit("20"), z)).otherwise(z), b, a))
            .when(F.rlike(s, F.lit(_COMPACT)), compact)
            .when(F.length(a) == 0, let(named, by_month)))
