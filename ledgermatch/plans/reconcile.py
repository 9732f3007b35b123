"""The whole reconciliation as one Spark plan.

invoice documents --split/extract--> invoices --(overlay answers)--+
statement grids / delimited lines / text lines --harmonise-->      |
                                         transactions -------------+--> match
--> flagged invoices, flagged transactions, run counts, rejects
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.enrichment import json_column_map, json_invoice_fields, json_transactions, overlay
from ..operators.extraction import extract_invoices
from ..operators.flags import mark_invoices, mark_transactions, observed_counts, summary_counts, summary_invoices
from ..operators.matching import match
from ..operators.statements import filter_valid, grid_rejects, grid_to_rows, harmonise, statement_rejects
from ..sources.delimited import delimited_rejects, delimited_to_rows
from ..sources.lines import parse_statement_lines
from ..sources.routing import supported, union_sources
from ..session import checkpoint_dir
from . import fixtures as fx


#: Why a statement of which no row was read has no transaction.
NO_ROW = "no row below the header"
TX_COLUMNS = ["statement_id", "row_idx", "date", "description", "amount"]


def load_transactions(statement_rows: DataFrame | None = None, delimited_lines: DataFrame | None = None,
                      statement_lines: DataFrame | None = None, grids: DataFrame | None = None,
                      column_answers: DataFrame | None = None, transaction_answers: DataFrame | None = None,
                      files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All statement sources -> (transactions, rejects).

    Rows come from ready rows, delimited text and raw grids; ``column_answers``
    (statement_id, answer) suggest columns where headers are not recognised.
    Text lines add what no row of their statement has. ``transaction_answers``
    (statement_id, answer) serve the statements that yield nothing else.
    ``files`` (``routing.list_files``: statement_id, reject_reason) is the
    inventory of the run: rows of files it refuses are left out.

    ``rejects``: statement_id and reason of every statement, in a source or in
    the inventory, without any transaction; also of those that gave no row at
    all (empty files, a header alone)."""
    given = {"rows": statement_rows, "delimited": delimited_lines, "lines": statement_lines, "grids": grids}
    given = {k: df if files is None else supported(df, files) for k, df in given.items() if df is not None}
    seen = [df.select("statement_id").distinct() for df in given.values()]
    rows, reasons = [], []
    if "rows" in given:
        rows.append(given["rows"].select("statement_id", "row_idx", "headers", "cells"))
    if "delimited" in given:
        rows.append(delimited_to_rows(given["delimited"]))
        reasons.append(delimited_rejects(given["delimited"]))
    if "grids" in given:
        rows.append(grid_to_rows(given["grids"]))
        reasons.append(grid_rejects(given["grids"]))
    if files is not None:
        seen.append(files.select("statement_id").distinct())
        reasons.append(files.where(F.col("reject_reason").isNotNull()).select("statement_id", F.col("reject_reason").alias("reason")))
    tx = None
    if rows:
        suggestions = None if column_answers is None else json_column_map(column_answers)
        # both feed several outputs: kept in the shared folder, which also keeps the plan small
        checkpoint_dir(rows[0].sparkSession)
        harmonised = harmonise(reduce(DataFrame.unionByName, rows).checkpoint(), suggestions=suggestions).checkpoint()
        reasons.append(statement_rejects(harmonised))
        tx = filter_valid(harmonised).select(*TX_COLUMNS).withColumn("row_source", F.lit("grid"))
    if "lines" in given:
        lines = parse_statement_lines(given["lines"]).select(*TX_COLUMNS)
        # stated of every statement: those with a transaction are left out below
        reasons.append(given["lines"].select("statement_id").distinct()
                       .select("statement_id", F.lit("no transaction line").alias("reason")))
        tx = lines.withColumn("row_source", F.lit("lines")) if tx is None else union_sources(tx, lines).checkpoint()
    if transaction_answers is not None:
        told = json_transactions(transaction_answers).select(*TX_COLUMNS).withColumn("row_source", F.lit("answers"))
        # read by the rejects too: lines and answers are parsed once
        checkpoint_dir(told.sparkSession)
        tx = told if tx is None else tx.unionByName(
            told.join(tx.select("statement_id").distinct(), "statement_id", "left_anti").checkpoint())
    if tx is None:
        raise ValueError("no statement source given")
    if not seen:
        return tx, tx.select("statement_id", F.lit(None).cast("string").alias("reason")).limit(0)
    empty = reduce(DataFrame.union, seen).distinct().join(tx.select("statement_id").distinct(), "statement_id", "left_anti")
    if not reasons:
        return tx, empty.withColumn("reason", F.lit(NO_ROW))
    known = reduce(DataFrame.unionByName, reasons).groupBy("statement_id").agg(F.min("reason").alias("reason"))
    return tx, empty.join(known, "statement_id", "left").withColumn("reason", F.coalesce("reason", F.lit(NO_ROW)))


def reconcile(invoice_docs: DataFrame, statement_rows: DataFrame | None = None,
              delimited_lines: DataFrame | None = None, statement_lines: DataFrame | None = None,
              answers: DataFrame | None = None, amount_tolerance=0.02, max_days: int = 90,
              persist: bool = True, grids: DataFrame | None = None, column_answers: DataFrame | None = None,
              transaction_answers: DataFrame | None = None, files: DataFrame | None = None,
              **match_options) -> dict[str, DataFrame]:
    """Returns ``invoices`` (flagged, no raw text), ``matches``,
    ``transactions`` (flagged), ``summary`` (one row of counts) and
    ``rejects`` (statements without a transaction, with the reason; with
    ``files``, the inventory of ``routing.list_files``, also empty and
    unsupported files).

    The extracted invoices and the harmonised transactions feed the match,
    both flag joins and the summary; with ``persist`` they are kept
    (memory and disk, recomputed from lineage if an executor is lost)
    instead of being re-extracted for every output; so is the match result,
    which feeds both flag joins. Call ``unpersist`` on ``out["_invoices"]``,
    ``out["_transactions"]`` and ``out["_matches"]`` when done."""
    inv = extract_invoices(invoice_docs).drop("raw_text")
    if answers is not None:
        inv = overlay(inv, json_invoice_fields(answers))
    tx, rejects = load_transactions(statement_rows, delimited_lines, statement_lines, grids, column_answers,
                                    transaction_answers, files)
    if persist:
        inv = inv.persist(StorageLevel.MEMORY_AND_DISK)
        tx = tx.persist(StorageLevel.MEMORY_AND_DISK)
    ikey = ["filename", "section_no"] + (["path"] if "path" in inv.columns else [])
    m = match(inv, tx, amount_tolerance, max_days, invoice_key=ikey, **match_options)
    if persist:
        m = m.persist(StorageLevel.MEMORY_AND_DISK)  # feeds both flag joins
    fi = summary_invoices(mark_invoices(inv, m))
    ft = mark_transactions(tx, m)
    return {"invoices": fi, "matches": m, "transactions": ft, "summary": summary_counts(fi, ft), "rejects": rejects,
            "_invoices": inv, "_transactions": tx, "_matches": m}


def write_results(out: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> dict[str, int]:
    """Write ``reconcile``'s tables as Parquet below ``folder`` (invoices,
    transactions, matches, rejects, summary) and return the run counts.

    The counts are observed while the flagged tables are written: neither is
    read again for the summary. Kept inputs are released at the end."""
    spark = out["invoices"].sparkSession
    invoices, transactions, counts = observed_counts(out["invoices"], out["transactions"])
    tables = {"matches": out["matches"], "invoices": invoices, "transactions": transactions, "rejects": out["rejects"]}
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")
    row = counts()
    spark.range(1).select(*[F.lit(row[c]).cast("long").alias(c) for c in out["summary"].columns]) \
        .write.mode(mode).parquet(f"{folder}/summary")
    for name in ("_matches", "_transactions", "_invoices"):
        if name in out:
            out[name].unpersist()
    return row


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice documents and statement lines derived from ``orders`` ->
    best match per invoice."""
    m = match(extract_invoices(fx.invtext_v(spark, sf_dir)),
              parse_statement_lines(fx.lines_v(spark, sf_dir)), 0.02, 90,
              invoice_key=["filename", "section_no"])
    return m.select("filename", "invoice_number", "invoice_date", "total_amount", "matched",
                    "match_score", "bank_date", "bank_amount", "bank_description", "n_candidates")
