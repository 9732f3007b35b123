"""Text helpers (F3, F4, F5, F14, F21, P5) as JVM-side column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body``
    names it. It is a lambda over a one-element array: what it computes stays
    out of the generated method, which the JVM compiles only while it is small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold_table(blocks=((0x00C0, 0x0250), (0x0370, 0x0530), (0x1E00, 0x1F00), (0x1F00, 0x2000))) -> tuple[str, str]:
    """Single-letter accent folding built from the Unicode rule:
    NFD-decompose and drop non-spacing marks (category Mn). Spark has no NFD
    function, so the precomposed letters of the Latin, Greek and Cyrillic
    blocks are folded with ``translate`` and any remaining combining mark is
    removed by a regex."""
    src, dst = [], []
    for lo, hi in blocks:
        for cp in range(lo, hi):
            ch = chr(cp)
            base = "".join(c for c in unicodedata.normalize("NFD", ch)
                           if unicodedata.category(c) != "Mn")
            if base != ch and len(base) == 1:
                src.append(ch)
                dst.append(base)
    return "".join(src), "".join(dst)


_FOLD_SRC, _FOLD_DST = _fold_table()
# What folding changes: letters of the table's blocks and combining marks. Most
# texts hold none, and looking is cheaper than folding.
_FOLDABLE = r"[\u00C0-\u024F\u0370-\u052F\u1E00-\u1FFF]|\p{Mn}"
# Latin-1 letters only: enough for month names and short tokens, and keeps
# generated code small where the fold is applied many times per row.
_LATIN1_SRC, _LATIN1_DST = _fold_table(((0x00C0, 0x0100),))


def strip_accents(text) -> Column:
    """Drop diacritics: ``Libellé`` -> ``Libelle``; ``ß`` has no decomposition
    and stays."""
    def fold(t):
        folded = F.regexp_replace(F.translate(t, _FOLD_SRC, _FOLD_DST), r"\p{Mn}+", "")
        return F.when(F.rlike(t, F.lit(_FOLDABLE)), folded).otherwise(t)
    return let(_col(text), fold)


def fold_latin1(text) -> Column:
    return F.translate(_col(text), _LATIN1_SRC, _LATIN1_DST)


def standardize_header(text) -> Column:
    """Accent-fold, lower-case, runs of non-alphanumerics -> one space, trim."""
    low = F.lower(strip_accents(F.coalesce(_col(text), F.lit(""))))
    return F.trim(F.regexp_replace(low, r"[^a-z0-9]+", " "))


def safe_lower(text) -> Column:
    return F.lower(F.coalesce(_col(text), F.lit("")))


# Unicode-aware trim: ``trim`` only removes ASCII spaces. The look-behind lets
# a trailing run start at its first blank only, which keeps inner runs linear.
_TRIM_RE = r"^[\s\p{Z}]++|(?<![\s\p{Z}])[\s\p{Z}]++$"


def ktrim(text) -> Column:
    return F.regexp_replace(_col(text), _TRIM_RE, "")


def trim_ends(text: Column) -> Column:
    """``ktrim`` of a value at hand (a column or lambda variable): only texts
    whose first or last character is a blank are searched."""
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(F.rlike(ends, F.lit(r"[\s\p{Z}]")), ktrim(text)).otherwise(text)


def text_lines(text) -> Column:
    """Trimmed, non-blank lines of a text as array<string> (P5)."""
    parts = F.split(F.replace(_col(text), F.lit("\r"), F.lit("")), "\n")
    return F.filter(F.transform(parts, trim_ends), lambda x: x != "")


def is_entity_line(line) -> Column:
    """A line that looks like a company or person name: at least three
    characters, at least one letter, and 60 % or more of its letters upper
    case (F14). Division guarded for ANSI mode."""
    c = _col(line)
    # count by deleting runs of everything else (one match per run, not per letter)
    def mostly_upper(letters):
        upper = F.length(F.regexp_replace(letters, r"\P{Lu}+", ""))
        # try_divide is NULL for a line without letters (no ANSI division error)
        return F.coalesce(F.try_divide(upper, F.length(letters)) >= 0.6, F.lit(False))
    return (F.length(c) >= 3) & let(F.regexp_replace(c, r"\P{L}+", ""), mostly_upper)


def json_block(text) -> Column:
    """The span from the first ``{`` to the last ``}`` of a free-text answer;
    NULL when there is none (F21)."""
    return let(F.regexp_extract(_col(text), r"(?s)\{.*\}", 0), lambda block: F.when(block != "", block))
