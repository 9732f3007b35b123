"""String similarity used for scoring and header detection.

* ``levenshtein_score``: normalised Levenshtein similarity x 100 (F15), native.
* ``partial_ratio``: best-window InDel similarity x 100 (F16), Arrow UDF.
* ``jaro_winkler``: Jaro-Winkler similarity (F18), Arrow UDF.

The two UDFs only ever see rows that survived the cheap filters (join
candidates, distinct header x rule pairs); they memoise per Arrow batch.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def levenshtein_score(number, description) -> Column:
    """100 * (1 - lev(a, b) / max(len a, len b)) on lower-cased strings;
    0 when the number is blank."""
    a = F.lower(_col(number))
    b = F.lower(F.coalesce(_col(description), F.lit("")))
    longest = F.greatest(F.length(a), F.length(b))
    sim = F.lit(100.0) * (F.lit(1.0) - F.levenshtein(a, b).cast("double") / longest.cast("double"))
    return F.when(F.coalesce(F.trim(_col(number)), F.lit("")) == "", F.lit(0.0)).otherwise(sim)


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word (or big
    integer) of ``a`` at a time: a step per character of ``b``."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * _lcs(a, b) / total


def partial_ratio_py(a: str, b: str) -> float:
    """Best similarity of the shorter string against every window of the
    longer one (full windows plus the partial windows at both ends)."""
    if a is None or b is None:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m == 0:
        return 100.0 if n == 0 else 0.0
    if a in b:
        return 100.0
    best = 0.0
    for i in range(1, m):
        best = max(best, _indel_ratio(a, b[:i]), _indel_ratio(a, b[n - i:]))
    for i in range(0, n - m + 1):
        best = max(best, _indel_ratio(a, b[i:i + m]))
        if best == 100.0:
            break
    if m == n:
        best = max(best, partial_ratio_window_swap(a, b))
    return best


def partial_ratio_window_swap(a: str, b: str) -> float:
    best = 0.0
    for i in range(1, len(b)):
        best = max(best, _indel_ratio(b, a[:i]), _indel_ratio(b, a[len(a) - i:]))
    return best


@F.pandas_udf(DoubleType())
def _partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    memo: dict = {}
    out = []
    for x, y in zip(a, b):
        key = (x, y)
        if key not in memo:
            memo[key] = partial_ratio_py(x, y)
        out.append(memo[key])
    return pd.Series(out, dtype="float64")


def partial_ratio(number, description) -> Column:
    """Symmetric partial ratio of the lower-cased strings (0..100); 0 when the
    number is blank."""
    a = F.lower(_col(number))
    b = F.lower(F.coalesce(_col(description), F.lit("")))
    # one string inside the other is settled in the JVM; only the rest is sent to Python
    rest = F.when((F.length(b) > 0) & ~F.contains(b, a) & ~F.contains(a, b), a)
    return F.when(F.coalesce(F.trim(_col(number)), F.lit("")) == "", F.lit(0.0)) \
        .when(F.length(b) == 0, F.lit(0.0)).when(F.contains(b, a) | F.contains(a, b), F.lit(100.0)) \
        .otherwise(_partial_ratio_udf(rest, b))


def jaro_winkler_py(a: str, b: str) -> float:
    """Jaro-Winkler similarity: scaling 0.1, common prefix up to 4, boost only
    when the Jaro similarity is over 0.7; an odd character out of place counts
    for no transposition."""
    if a is None or b is None:
        return 0.0
    if a == b:
        return 1.0
    lo, hi = (a, b) if len(a) <= len(b) else (b, a)
    window = max(len(hi) // 2 - 1, 0)
    hi_flags = [False] * len(hi)
    lo_hits = []
    for i, ch in enumerate(lo):
        for j in range(max(i - window, 0), min(i + window + 1, len(hi))):
            if not hi_flags[j] and hi[j] == ch:
                hi_flags[j] = True
                lo_hits.append(ch)
                break
    m = len(lo_hits)
    if m == 0:
        return 0.0
    hi_hits = [hi[j] for j in range(len(hi)) if hi_flags[j]]
    transpositions = sum(1 for x, y in zip(lo_hits, hi_hits) if x != y) // 2
    prefix = 0
    for i in range(min(4, len(lo))):
        if a[i] == b[i]:
            prefix += 1
        else:
            break
    j = (m / len(a) + m / len(b) + (m - transpositions) / m) / 3
    return j if j <= 0.7 else j + 0.1 * prefix * (1 - j)


@F.pandas_udf(DoubleType())
def _jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    memo: dict = {}
    out = []
    for x, y in zip(a, b):
        key = (x, y)
        if key not in memo:
            memo[key] = jaro_winkler_py(x, y)
        out.append(memo[key])
    return pd.Series(out, dtype="float64")


def jaro_winkler(a, b) -> Column:
    return _jaro_winkler_udf(_col(a), _col(b))


# Ship this module's code with the UDFs (by value), so that Python workers do
# not need the package installed or on their path.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
