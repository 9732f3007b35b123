"""Bank statements of any layout -> one transaction table (S3, J8, P7, P2,
P3, O1).

``statement_rows``: statement_id, row_idx, headers array<string>,
cells array<string>. ``row_idx`` orders the rows of a statement's grid (or
file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.amounts import parse_amount
from ..functions.dates import parse_date
from ..functions.text import ktrim, let, trim_ends
from .columns import detect_columns, suggested_map
from .once import evaluate_once

HEADER_MIN_CELLS = 2     # fixed value: a header has at least two non-empty cells


def non_empty_cells(cells) -> Column:
    """Number of non-blank cells of a row."""
    c = F.col(cells) if isinstance(cells, str) else cells
    return F.size(F.filter(c, lambda x: F.coalesce(ktrim(x), F.lit("")) != ""))


def grid_headers(grid: DataFrame, min_cells: int = HEADER_MIN_CELLS) -> DataFrame:
    """Per statement the first row with at least ``min_cells`` non-empty
    cells, wherever it stands: header_idx and its trimmed cells as
    ``headers``; both NULL for a statement without such a row."""
    cells = F.transform("cells", lambda x: F.coalesce(ktrim(x), F.lit("")))
    candidate = F.when(non_empty_cells("cells") >= min_cells, F.struct("row_idx", cells.alias("headers")))
    return grid.groupBy("statement_id").agg(F.min(candidate).alias("_h")) \
        .select("statement_id", F.col("_h.row_idx").alias("header_idx"), F.col("_h.headers").alias("headers"))


def grid_to_rows(grid: DataFrame, min_cells: int = HEADER_MIN_CELLS) -> DataFrame:
    """S3: attach each statement's header (``grid_headers``) to every later
    row. Statements without a header yield nothing here and a row of
    ``grid_rejects``.

    The header comes out of one aggregation (partial per task); attaching it
    is one join on statement_id that AQE may broadcast or split."""
    rows = grid.join(grid_headers(grid, min_cells), on="statement_id", how="inner") \
        .where(F.col("row_idx") > F.col("header_idx"))
    return rows.select("statement_id", "row_idx", "headers", "cells")


def grid_rejects(grid: DataFrame, min_cells: int = HEADER_MIN_CELLS) -> DataFrame:
    """Statements of which no row can be a header: statement_id, reason."""
    return grid_headers(grid, min_cells).where(F.col("header_idx").isNull()) \
        .select("statement_id", F.lit("no header row").alias("reason"))


def signed_amount(amount, debit, credit) -> Column:
    """The amount cell if it parses; else debit != 0 -> -|debit|, else
    credit != 0 -> +|credit|, else NULL."""
    return F.coalesce(amount, F.when(debit != 0, -F.abs(debit)).when(credit != 0, F.abs(credit)))


MAP_FIELDS = ["date_idx", "description_idx", "amount_idx", "debit_idx", "credit_idx"]

#: Parts into which the rows of one header list are dealt for the join with its
#: map: a run has few lists, and a list's rows would else be one task.
LAYOUT_PARTS = 64


def _with_maps(rows: DataFrame, maps: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` (with ``_part``) left joined to ``maps``, which are copied to
    every part: small rows, one a header list (and statement)."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(LAYOUT_PARTS - 1)))
    return rows.join(maps.withColumn("_part", parts), on=[*on, "_part"], how="left")


def harmonise(statement_rows: DataFrame, column_map: DataFrame | None = None,
              suggestions: DataFrame | None = None) -> DataFrame:
    """Apply the column map of each row's header list.

    ``suggestions`` (statement_id and the five names of
    ``enrichment.json_column_map``) serve the statements whose headers are
    not recognised: their resolved names replace the failed map.

    Output: statement_id, row_idx, date, description, amount,
    reject_reason (layout-level; NULL when the layout is usable).
    """
    cmap = column_map if column_map is not None else detect_columns(statement_rows.select("headers"))
    part = F.pmod(F.hash("statement_id", "row_idx", "cells"), F.lit(LAYOUT_PARTS))
    j = _with_maps(statement_rows.select("statement_id", "row_idx", "headers", "cells", part.alias("_part")), cmap, ["headers"])
    if suggestions is not None:
        failed = statement_rows.select("statement_id", "headers").distinct() \
            .join(cmap.where(F.col("reject_reason").isNotNull()).select("headers"), "headers")
        given = suggested_map(failed, suggestions).select(
            "statement_id", "headers", F.struct(*MAP_FIELDS).alias("_given"))
        j = _with_maps(j, given, ["statement_id", "headers"])
        ok = F.col("_given").isNotNull()
        j = j.select("statement_id", "row_idx", "headers", "cells",
                     *[F.when(ok, F.col("_given")[f]).otherwise(F.col(f)).alias(f) for f in MAP_FIELDS],
                     F.when(~ok, F.col("reject_reason")).alias("reject_reason"))

    def cell(idx):
        return F.when(F.col(idx).isNotNull(), F.get(F.col("cells"), F.col(idx)))

    # the three money cells share one parser instance (smaller generated code)
    parsed = F.transform(F.array(cell("amount_idx"), cell("debit_idx"), cell("credit_idx")), parse_amount)
    amount = signed_amount(parsed[0], parsed[1], parsed[2])
    reason = F.when(F.col("date_idx").isNull() & F.col("reject_reason").isNull(), F.lit("unknown layout")) \
        .otherwise(F.col("reject_reason"))
    base = j.select("statement_id", "row_idx", "cells", *MAP_FIELDS, reason.alias("_reason"))
    out = evaluate_once(base, {"date": parse_date(cell("date_idx")),
                               "description": let(cell("description_idx"), trim_ends),
                               "amount": amount})
    return out.select("statement_id", "row_idx", "date", "description", "amount",
                      F.col("_reason").alias("reject_reason"))


def drop_reason(df: DataFrame) -> Column:
    """Why a harmonised row is not a transaction (first failing test, in the
    order layout, date, description, amount); NULL for kept rows."""
    return (F.when(F.col("reject_reason").isNotNull(), F.col("reject_reason"))
            .when(F.col("date").isNull(), F.lit("no date"))
            .when(F.coalesce(F.col("description"), F.lit("")) == "", F.lit("no description"))
            .when(F.col("amount").isNull(), F.lit("no amount")))


def filter_valid(df: DataFrame) -> DataFrame:
    """Keep rows with a date, a non-blank description and an amount."""
    return df.where(drop_reason(df).isNull()).drop("reject_reason")


def reject_report(df: DataFrame) -> DataFrame:
    """Per statement, rows in, rows kept and rows dropped by reason."""
    r = drop_reason(df)
    return df.groupBy("statement_id").agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(r.isNull()).alias("rows_kept"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("dropped_layout"),
        F.count_if(r == "no date").alias("dropped_no_date"),
        F.count_if(r == "no description").alias("dropped_no_description"),
        F.count_if(r == "no amount").alias("dropped_no_amount"))


def require_transactions(report: DataFrame) -> DataFrame:
    """Opt-in assertion: fail the job if a statement yields no transaction
    (the reference rejects such an upload)."""
    return report.withColumn("_check", F.when(
        F.col("rows_kept") == 0,
        F.raise_error(F.concat(F.lit("no transaction found in statement "), F.col("statement_id"))))) \
        .drop("_check")


def statement_rejects(harmonised: DataFrame) -> DataFrame:
    """Statements none of whose rows is a transaction: statement_id and the
    reason that most rows share (the smallest among equals)."""
    counted = harmonised.groupBy("statement_id", drop_reason(harmonised).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    worst = counted.groupBy("statement_id").agg(F.count_if(F.col("reason").isNull()).alias("kept"),
                                                F.min_by("reason", F.struct(-F.col("n"), "reason")).alias("reason"))
    return worst.where("kept = 0").select("statement_id", "reason")


def load_statements(statement_rows: DataFrame, suggestions: DataFrame | None = None) -> DataFrame:
    """Column detection + harmonisation + validity filter in one plan."""
    return filter_valid(harmonise(statement_rows, suggestions=suggestions))


def sort_transactions(tx: DataFrame) -> DataFrame:
    """O1: transactions by date, then statement and row (stable)."""
    return tx.orderBy("date", "statement_id", "row_idx")
