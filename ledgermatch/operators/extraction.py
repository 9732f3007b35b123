"""Invoice documents -> sections -> fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import invoice_fields as IF
from ..functions.amounts import parse_amount
from ..functions.dates import parse_date
from ..functions.text import ktrim, let, trim_ends
from .once import evaluate_once

# Fixed value: a new invoice starts at a line beginning with
# "reçu n°" / "facture" / "invoice" (case-insensitive); used as a zero-width
# split point after a newline.
SECTION_START = r"(?iu)(?<=\n)(?=(?:re[çc]u\s*n[°o]|facture|invoice)\b)"
# The same on single lines: a marker line, and one that goes on in the next line.
_MARKER_LINE = r"(?iu)^(?:re[çc]u\s*n[°o]|facture|invoice)\b"
_OPEN_MARKER, _NUMBER_LINE = r"(?iu)^re[çc]u$", r"(?iu)^\s*n[°o]\b"
#: Numbers of lines (or pages) of one document that are taken in one task.
LINE_PART = 1 << 14
# Trailing blanks of every line (only \n ends a line), and carriage returns;
# the blank is tested before the look-behind, which few characters then reach.
_BLANK = r"[\t\x0B\f\x1C-\x1F\p{Z}]"
_LINE_END_BLANKS = rf"(?md)(?={_BLANK})(?<!{_BLANK}){_BLANK}++$"


def normalize_text(text) -> F.Column:
    c = F.col(text) if isinstance(text, str) else text
    return let(F.regexp_replace(F.replace(c, F.lit("\r"), F.lit("")), _LINE_END_BLANKS, ""), trim_ends)


def split_sections(docs: DataFrame, text_col: str = "text", filename_col: str = "filename") -> DataFrame:
    """One row per invoice section of each document.

    Output: source_file, filename (``name#n`` when the document has more
    than one section), section_no (1-based), n_sections, text. Documents
    with blank text yield no row.
    """
    parts = F.split(normalize_text(text_col), SECTION_START)
    secs = F.filter(F.transform(parts, trim_ends), lambda x: x != "")
    others = [c for c in docs.columns if c not in (text_col, filename_col)]
    # counted below the generator: above it, every section would carry the whole document
    exploded = docs.select(F.col(filename_col).alias("source_file"), *others, secs.alias("_secs")) \
        .withColumn("n_sections", F.size("_secs")) \
        .select("source_file", *others, "n_sections", F.posexplode("_secs").alias("_pos", "text"))
    section_no = (F.col("_pos") + 1).cast("int")
    label = F.when(F.col("n_sections") > 1,
                   F.concat(F.col("source_file"), F.lit("#"), section_no.cast("string"))) \
        .otherwise(F.col("source_file"))
    return exploded.select("source_file", *others, label.alias("filename"), section_no.alias("section_no"),
                           F.col("n_sections").cast("int").alias("n_sections"), "text")


def split_sections_by_line(lines: DataFrame, key: list[str], order: list[str], text_col: str = "text",
                           filename_col: str = "filename", part: int = LINE_PART) -> DataFrame:
    """The rows of ``split_sections`` for documents that come as lines or as
    pages and are never put together: only a section is one row.

    ``key`` names the document (nulls are values; its columns are kept),
    ``order`` the place of a row in it, unique there, first an integer; a row
    holds one line or several, and rows join by a newline.

    A section starts at a marker line. The lines of a document are cut into
    ranges of ``part`` numbers of the first order column, and windows see a
    range each. A running sum of the markers in a range, and the sums of the
    ranges before it (one row a range), name a line's section. Only what stands
    before the first marker can be blank, so a document's first line with text
    tells whether that part counts. Lines join to texts inside their range. So
    one long document spreads over tasks; what has to fit in one is a range and
    a section."""
    text = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\r"), F.lit(""))
    start = F.coalesce(F.floor(F.col(order[0]) / part), F.lit(-1 << 62))
    rows = lines.select(F.struct(*key).alias("_doc"), start.alias("_part"), F.struct(*order).alias("_at"),
                        F.col(filename_col).alias("source_file"), F.posexplode(F.split(text, "\n")).alias("_i", "_line")) \
        .withColumn("_line", F.regexp_replace("_line", _LINE_END_BLANKS, ""))
    # "reçu" alone on its line is a marker where the next line with text goes on with "n°"
    rows = rows.select("*", F.when(F.col("_line") != "", F.rlike("_line", F.lit(_NUMBER_LINE))).alias("_goes_on"),
                       F.rlike("_line", F.lit(_MARKER_LINE)).alias("_marker"), F.rlike("_line", F.lit(_OPEN_MARKER)).alias("_bare"))
    own = Window.partitionBy("_doc", "_part").orderBy("_at", "_i")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    # LEAD looks at each row once; a frame up to the range's end would be read anew for each row
    rows = rows.withColumn("_next", F.expr("LEAD(_goes_on) IGNORE NULLS OVER (PARTITION BY _doc, _part ORDER BY _at, _i)"))
    # a range's last line with text may be left open: the range that follows tells
    rows = rows.withColumn("_mark", F.col("_marker") | (F.col("_bare") & F.coalesce("_next", F.lit(False)))) \
        .withColumn("_open", F.col("_bare") & ~F.col("_marker") & F.col("_next").isNull())
    told = F.col("_goes_on").isNotNull()
    parts = rows.groupBy("_doc", "_part").agg(
        F.min(F.when(told, F.struct("_at", "_i", "_goes_on", "_mark", "_open"))).alias("_f"),
        F.count_if("_mark").alias("_marks"), F.count_if("_open").alias("_opens"))
    doc = Window.partitionBy("_doc").orderBy("_part")  # a row a part
    whole = doc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.withColumn("_first", F.col("_f._goes_on")) \
        .withColumn("_closes", F.coalesce(F.expr("LEAD(_first) IGNORE NULLS OVER (PARTITION BY _doc ORDER BY _part)"), F.lit(False))) \
        .withColumn("_n", F.col("_marks") + F.when(F.col("_closes"), F.col("_opens")).otherwise(0)) \
        .withColumn("_led", F.col("_f._mark") | (F.col("_f._open") & F.col("_closes")))
    parts = parts.select(
        "_doc", "_part", "_closes", F.coalesce(F.sum("_n").over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_n").over(whole).alias("_all"), F.when(F.first("_led", ignorenulls=True).over(whole), 0).otherwise(1).alias("_lead"))
    # every line has its range's row; a left join cannot broadcast the lines
    marked = rows.select("_doc", "_part", "_at", "_i", "source_file", "_line", F.count_if("_mark").over(so_far).alias("_m"),
                         F.count_if("_open").over(so_far).alias("_o")).join(parts, ["_doc", "_part"], "left") \
        .withColumn("_sec", F.col("_base") + F.col("_m") + F.when(F.col("_closes"), F.col("_o")).otherwise(0))

    def joined(collected, value):
        return F.array_join(F.transform(F.array_sort(collected), lambda x: x[value]), "\n")
    pieces = marked.groupBy("_doc", "_part", "_sec").agg(
        F.max("source_file").alias("source_file"), F.first("_all").alias("_all"), F.first("_lead").alias("_lead"),
        joined(F.collect_list(F.struct("_at", "_i", "_line")), "_line").alias("_text"))
    made = pieces.groupBy("_doc", "_sec").agg(
        F.max("source_file").alias("source_file"), (F.first("_all") + F.first("_lead")).cast("int").alias("n_sections"),
        (F.col("_sec") + F.first("_lead")).cast("int").alias("section_no"),
        ktrim(joined(F.collect_list(F.struct("_part", "_text")), "_text")).alias("text")).where("text <> ''")
    label = F.when(F.col("n_sections") > 1, F.concat("source_file", F.lit("#"), F.col("section_no").cast("string"))) \
        .otherwise(F.col("source_file"))
    return made.select(
        "source_file", *[F.col("_doc")[c].alias(c) for c in key if c != filename_col], label.alias("filename"), "section_no",
        "n_sections", "text")


def extract_fields(sections: DataFrame, text_col: str = "text") -> DataFrame:
    """Heuristic fields of each section; keeps every input column and
    adds invoice_number, invoice_date, total_amount, currency,
    currency_detected, supplier_name, customer_name, header_snippet."""
    # tokens first, then their values: a parse reads its token many times, and
    # what is looked for next is only looked for where nothing was found yet
    first = evaluate_once(sections.withColumn("_fold", IF.folded(text_col))
                          .withColumn("_low", F.lower(F.col("_fold")))
                          .withColumn("_lines", IF.section_lines(text_col))
                          .withColumn("_ent", IF.entity_flags("_lines")), {
        "_date_token": IF.labelled_date("_low"), "_total_token": IF.labelled_total("_low", 0)})
    second = evaluate_once(first, {"_date": parse_date("_date_token"), "_total": parse_amount("_total_token")})
    third = evaluate_once(second, {
        "_date_token2": F.when(F.col("_date").isNull(), IF.any_date("_low")),
        "_total_token2": F.when(F.col("_total").isNull(), IF.labelled_total("_low", 1))})
    out = evaluate_once(third, {
        "invoice_number": IF.find_invoice_number("_fold"),
        "invoice_date": F.coalesce("_date", parse_date("_date_token2")),
        "total_amount": F.coalesce("_total", parse_amount("_total_token2"), IF.text_max_amount("_low")),
        "currency_detected": IF.currency_detected("_low"),
        "supplier_name": IF.infer_supplier("_lines", "_ent"),
        "header_snippet": IF.header_snippet("_lines")})
    out = out.withColumn("currency", F.when(F.col("currency_detected"), F.lit("EUR"))
                         .otherwise(F.lit(IF.DEFAULT_CURRENCY)))
    out = out.withColumn("customer_name", IF.infer_customer("_lines", "supplier_name", "_ent"))
    return out.drop("_fold", "_low", "_lines", "_ent", "_date_token", "_total_token", "_date", "_total",
                    "_date_token2", "_total_token2")


def extract_invoices(docs: DataFrame, text_col: str = "text", filename_col: str = "filename",
                     split: bool = True) -> DataFrame:
    """Documents -> one invoice row per section (the reference's default
    extraction path). ``raw_text`` keeps the section text; drop it for
    summaries (P4)."""
    if split:
        secs = split_sections(docs, text_col, filename_col)
    else:
        secs = docs.withColumnRenamed(filename_col, "source_file") \
            .withColumn("filename", F.col("source_file")) \
            .withColumn("section_no", F.lit(1)).withColumn("n_sections", F.lit(1)) \
            .withColumn("text", normalize_text(text_col))
    fields = extract_fields(secs, "text")
    return fields.withColumnRenamed("text", "raw_text")
