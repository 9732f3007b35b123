"""Sinks (S6, S7, S8, F26).

Files are written by Spark's own writers, one part file per partition, so
nothing passes through the driver. The per-row renderers give the exact
text of one record (used for checks and for streaming ``foreachBatch``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.amounts import AMOUNT_TYPE

# Invoice XML layout (root, row and field element names).
XML_ROOT = "invoices"
XML_ROW = "invoice"
XML_FIELDS = ["filename", "invoice_number", "invoice_date", "total_amount", "currency"]


def xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def invoice_xml_fields(df: DataFrame) -> DataFrame:
    """XML field texts: ISO date, amount with two decimals, '' for NULL."""
    return df.select(
        F.coalesce(F.col("filename"), F.lit("")).alias("filename"),
        F.coalesce(F.col("invoice_number"), F.lit("")).alias("invoice_number"),
        F.coalesce(F.date_format("invoice_date", "yyyy-MM-dd"), F.lit("")).alias("invoice_date"),
        F.coalesce(F.col("total_amount").cast(AMOUNT_TYPE).cast("string"), F.lit("")).alias("total_amount"),
        F.coalesce(F.col("currency"), F.lit("")).alias("currency"))


def invoice_xml_element(df: DataFrame) -> Column:
    """One ``<invoice>`` element, indented by two spaces per level; empty
    fields are written as empty elements."""
    parts = [F.lit(f"  <{XML_ROW}>\n")]
    for f in XML_FIELDS:
        v = F.col(f)
        parts.append(F.when(v == "", F.lit(f"    <{f}/>\n")).otherwise(
            F.concat(F.lit(f"    <{f}>"), xml_escape(v), F.lit(f"</{f}>\n"))))
    parts.append(F.lit(f"  </{XML_ROW}>"))
    return F.concat(*parts)


def write_invoices_xml(invoices: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``<invoices><invoice>...`` via Spark's XML writer (one document
    per partition)."""
    invoice_xml_fields(invoices).write.mode(mode).format("xml") \
        .option("rootTag", XML_ROOT).option("rowTag", XML_ROW).option("nullValue", "") \
        .option("indent", "  ").save(path)


MATCH_COLUMNS = ["filename", "invoice_number", "invoice_date", "total_amount", "matched",
                 "match_score", "bank_date", "bank_amount", "bank_description"]


def write_matches_csv(matches: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Matches as CSV with a header row, no index column."""
    matches.select(*MATCH_COLUMNS).write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, one object per row."""
    df.write.mode(mode).json(path)


def csv_line(cols) -> Column:
    return F.to_csv(F.struct(*cols))


def json_line(cols) -> Column:
    return F.to_json(F.struct(*cols))
