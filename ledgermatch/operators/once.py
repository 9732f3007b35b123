"""Evaluate expensive column expressions once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def evaluate_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add ``columns`` to ``df``, each computed exactly once per row.

    The values come out of a one-row ``inline`` generator. Catalyst pushes
    filters through projections by substituting the projected expressions,
    so ``parse(...) IS NOT NULL`` would otherwise re-run the whole parse in
    the filter; it does not push into a generator, so a later filter on
    these columns reads them instead of recomputing them.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
