"""Statement column detection.

Works on *distinct header lists* (one row per statement layout, not per
statement row): the header list is exploded, each header meets the rule
list (a literal array exploded in place, not a join), and each field takes
the best header of its layout by aggregation.

Rule per field, in this order: an exact match of a standardised header with
one of the field's candidates (earliest candidate wins), else a header that
contains a candidate (earliest header wins), else the best Jaro-Winkler
similarity >= 0.85. A header that is an exact hit of one field is never
taken by another field through the weaker rules, and "solde" (balance) only
serves as the amount when there is neither an amount nor a debit/credit
column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.similarity import jaro_winkler
from ..functions.text import standardize_header
from .once import evaluate_once

# Candidate header names per field, in priority order.
FIELD_CANDIDATES = {
    "date": ["date", "date operation", "operation date", "transaction date", "booking date", "valeur"],
    "description": ["description", "libelle", "label", "details", "detail", "narration"],
    "amount": ["montant", "amount", "montant eur", "debit/credit", "debit credit"],
    "debit": ["debit", "retrait"],
    "credit": ["credit", "versement"],
    "balance": ["solde"],
}
FIELDS = list(FIELD_CANDIDATES)
JW_THRESHOLD = 0.85
SUGGESTED_THRESHOLD = 0.75


def _rules():
    return F.array(*[F.struct(F.lit(f).alias("field"), F.lit(r).alias("rank"), F.lit(c).alias("cand"))
                     for f, cands in FIELD_CANDIDATES.items() for r, c in enumerate(cands)])


def _layouts(layouts: DataFrame, headers_col: str) -> DataFrame:
    """Distinct header lists under a digest: pairs and matches carry the
    digest, however many headers a list has. Both come out of a generator, below
    which no branch's filter is pushed: the rows are read once for all of them."""
    known = layouts.select(F.col(headers_col).alias("_known")).distinct()
    return evaluate_once(known, {"layout": F.sha2(F.to_json(F.struct(F.col("_known").alias("headers"))), 256),
                                 "headers": F.col("_known")}).drop("_known")


def header_rule_pairs(layouts: DataFrame) -> DataFrame:
    """(layout, idx, header, std, field, rank, cand, exact, contains, jw) of
    ``_layouts``."""
    h = layouts.select("layout", F.posexplode("headers").alias("idx", "header")) \
        .withColumn("std", standardize_header("header"))
    r = h.withColumn("rule", F.explode(_rules())).select(
        "layout", "idx", "header", "std", "rule.field", "rule.rank", "rule.cand")
    return r.withColumn("exact", F.col("std") == F.col("cand")) \
        .withColumn("contains", (F.col("std") != "") & F.contains(F.col("std"), F.col("cand"))) \
        .withColumn("jw", jaro_winkler(F.col("std"), F.col("cand")))


def _best(layouts: DataFrame) -> DataFrame:
    p = header_rule_pairs(layouts)
    exact_hits = p.where("exact").groupBy("layout", "field") \
        .agg(F.min_by("idx", F.struct("rank", "idx")).alias("claimed_idx"))
    claims = exact_hits.select("layout", F.col("claimed_idx").alias("idx"),
                               F.col("field").alias("claim_field"))
    free = p.join(claims, on=[p.layout == claims.layout, p.idx == claims.idx,
                              p.field != claims.claim_field], how="left_anti")
    return free.groupBy("layout", "field").agg(
        F.min_by(F.when(F.col("exact"), F.col("idx")),
                 F.when(F.col("exact"), F.struct("rank", "idx"))).alias("exact_idx"),
        F.min(F.when(F.col("contains"), F.col("idx"))).alias("contains_idx"),
        F.max_by(F.col("idx"), F.struct("jw", -F.col("idx"), -F.col("rank"))).alias("jw_idx"),
        F.max("jw").alias("jw_best"))


def header_best_match(layouts: DataFrame, headers_col: str = "headers") -> DataFrame:
    """A5: per (headers, field) the exact, containing and best-similarity
    header positions and the best similarity."""
    known = _layouts(layouts, headers_col)
    return _best(known).join(known, "layout").drop("layout")


def detect_columns(layouts: DataFrame, headers_col: str = "headers") -> DataFrame:
    """one row per distinct header list with the chosen column index of
    each field (NULL when absent) and a reject reason (NULL when usable).
    Debit and credit columns are kept beside an amount column: they serve the
    rows whose amount cell holds none."""
    known = _layouts(layouts, headers_col)
    chosen = F.coalesce(F.col("exact_idx"), F.col("contains_idx"),
                        F.when(F.col("jw_best") >= JW_THRESHOLD, F.col("jw_idx")))
    wide = _best(known).groupBy("layout").pivot("field", FIELDS).agg(F.first(chosen))
    amount = F.coalesce(F.col("amount"), F.when(F.col("debit").isNull() & F.col("credit").isNull(),
                                                F.col("balance")))
    reason = (F.when(F.col("date").isNull(), F.lit("no date column"))
              .when(F.col("description").isNull(), F.lit("no description column"))
              .when(amount.isNull() & F.col("debit").isNull() & F.col("credit").isNull(),
                    F.lit("no amount column")))
    return wide.join(known, "layout").select(
        F.col("headers"),
        F.col("date").cast("int").alias("date_idx"),
        F.col("description").cast("int").alias("description_idx"),
        amount.cast("int").alias("amount_idx"),
        F.col("debit").cast("int").alias("debit_idx"),
        F.col("credit").cast("int").alias("credit_idx"),
        reason.alias("reject_reason"))


def resolve_suggested_column(suggestions: DataFrame, suggested_col: str = "suggested",
                             headers_col: str = "headers") -> DataFrame:
    """map a suggested column name to a real header of the row's header
    list: equal standardised name, else Jaro-Winkler >= 0.75; NULL otherwise.
    Adds ``resolved`` (the header text) and ``resolved_idx`` to every row.

    Names are resolved once per distinct (header list, suggestion); rows with
    an empty or missing list or suggestion keep NULL."""
    asked = suggestions.select(F.col(headers_col).alias("_headers"), F.col(suggested_col).alias("_suggested")) \
        .where((F.size("_headers") > 0) & (F.trim("_suggested") != "")).distinct()
    pairs = asked.withColumn("_target", standardize_header("_suggested")) \
        .select("*", F.posexplode("_headers").alias("_idx", "_header")) \
        .withColumn("_std", standardize_header("_header")) \
        .withColumn("_jw", jaro_winkler(F.col("_std"), F.col("_target")))
    best = pairs.groupBy("_headers", "_suggested").agg(
        F.min(F.when(F.col("_std") == F.col("_target"), F.col("_idx"))).alias("_eq"),
        F.max_by("_idx", F.struct("_jw", -F.col("_idx"))).alias("_jw_idx"),
        F.max("_jw").alias("_jw_best"))
    idx = F.coalesce(F.col("_eq"), F.when(F.col("_jw_best") >= SUGGESTED_THRESHOLD, F.col("_jw_idx")))
    found = best.select("_headers", "_suggested", idx.cast("int").alias("resolved_idx"))
    out = suggestions.join(found, on=[suggestions[headers_col] == found["_headers"],
                                      suggestions[suggested_col] == found["_suggested"]], how="left")
    return out.withColumn("resolved", F.get(F.col(headers_col), F.col("resolved_idx"))).drop("_headers", "_suggested")


def suggested_map(layouts: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Column maps from suggested names, one per (statement_id, headers) whose
    suggestions resolve to a date, a description and some amount column.

    ``layouts``: statement_id, headers. ``suggestions``: statement_id and the
    five names of ``enrichment.json_column_map``; of several suggestions for
    a statement the first in name order counts."""
    names = ["date_column", "description_column", "amount_column", "debit_column", "credit_column"]
    one = suggestions.groupBy("statement_id").agg(F.min(F.struct(*names)).alias("_s")).select("statement_id", "_s.*")
    asked = layouts.select("statement_id", "headers").distinct().join(one, "statement_id")
    long = asked.select("statement_id", "headers", F.explode(F.array(*[
        F.struct(F.lit(n[:-len("_column")]).alias("field"), F.col(n).alias("suggested")) for n in names])).alias("_f")) \
        .select("statement_id", "headers", "_f.*")
    wide = resolve_suggested_column(long).groupBy("statement_id", "headers") \
        .pivot("field", [n[:-len("_column")] for n in names]).agg(F.first("resolved_idx"))
    usable = wide.where(F.col("date").isNotNull() & F.col("description").isNotNull()
                        & F.coalesce("amount", "debit", "credit").isNotNull())
    return usable.select("statement_id", "headers", *[F.col(n[:-len("_column")]).alias(n[:-len("_column")] + "_idx")
                                                      for n in names])
