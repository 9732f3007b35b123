"""Sections of documents that come as lines or pages: the rows of ``split_sections``."""

import random
import time

from pyspark.sql import functions as F

from ledgermatch.operators.extraction import extract_fields, extract_invoices, split_sections, split_sections_by_line
from ledgermatch.sources.documents import concat_pages

PIECES = ["Facture 1", "  Facture 2", "facture", "FACTURES", "Invoice A", "Reçu n° 12", "reçu n°13", "reçu", "REÇU", "n°7", "  n° 8", "no 9",
          "nom", "", "  ", " ", "x  ", "Total 10,00\r", "a\nFacture 3\n", "reçu\n\n", "\n", None]


def _documents(spark):
    rng = random.Random(5)
    rows = [(f"d{d}.txt", f"/p{d % 2}" if d % 7 else None, p, rng.choice(PIECES)) for d in range(120) for p in range(rng.randint(1, 14))]
    return spark.createDataFrame(rows, "filename string, path string, page int, text string")


def test_equals_the_split_of_the_whole_text(spark):
    pages = _documents(spark)
    whole = concat_pages(pages.withColumn("doc", F.struct("filename", "path")), "doc", "page").select("doc.*", "text")
    cols = ["source_file", "path", "filename", "section_no", "n_sections", "text"]
    want = sorted(map(repr, (tuple(r) for r in split_sections(whole).select(cols).collect())))
    assert len(want) > 200
    for part in (1, 3, 1 << 14):
        got = split_sections_by_line(pages, ["filename", "path"], ["page"], part=part).select(cols).collect()
        assert sorted(map(repr, (tuple(r) for r in got))) == want, part


def test_fields_come_out_alike(spark):
    text = "SOCIETE X\nFacture N° INV-1\nDate : 05/01/2024\nTotal 10,00\nFacture N° INV-2\nTotal 20,00 EUR"
    docs = spark.createDataFrame([("a.pdf", text)], "filename string, text string")
    lines = spark.createDataFrame([("a.pdf", i, t) for i, t in enumerate(text.split("\n"))], "filename string, line_no long, text string")
    cols = ["filename", "section_no", "invoice_number", "invoice_date", "total_amount", "supplier_name", "customer_name", "header_snippet"]
    want = extract_invoices(docs).select(cols).collect()
    got = extract_fields(split_sections_by_line(lines, ["filename"], ["line_no"], part=2)).select(cols).collect()
    assert sorted(want) == sorted(got) and len(got) == 3


def test_nulls_and_empty_tables(spark):
    rows = [(None, None, "Facture 1"), (None, 2, "Facture 2"), ("b", 1, None), ("b", 2, " ")]
    lines = spark.createDataFrame(rows, "filename string, n int, text string")
    got = split_sections_by_line(lines, ["filename"], ["n"], part=1).collect()
    assert sorted((r.source_file, r.section_no, r.n_sections, r.text) for r in got) == [(None, 1, 2, "Facture 1"), (None, 2, 2, "Facture 2")]
    assert split_sections_by_line(lines.limit(0), ["filename"], ["n"]).count() == 0


def test_no_window_over_a_whole_document(spark):
    """Lines are only sorted inside a range; what is summed by document alone is one row a range."""
    plan = split_sections_by_line(_documents(spark), ["filename"], ["page"])._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("\n"):
        if "Window [" in line and "_line" in line:
            assert "_part" in line.rsplit("], [", 2)[1]


def test_ranges_are_read_once(spark):
    """Lines pass a window that looks ahead row by row, not over the rest of the range, and are
    dealt out by range twice at most (once for the sums of the ranges, once for the rows)."""
    made = split_sections_by_line(_documents(spark), ["filename"], ["page"])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "UnboundedFollowing" not in plan.replace("specifiedwindowframe(RowFrame, unboundedpreceding$(), unboundedfollowing$())", "") \
        and "1, unboundedfollowing$()" not in plan
    assert plan.count("Generate posexplode") <= 2


def test_long_range_is_linear(spark):
    """One range of 60,000 lines, most of them blank: looking ahead must not cost the square of its lines."""
    lines = spark.range(60_000).selectExpr("'d' filename", "cast(id / 8 as bigint) n", "id % 8 m",
                                           "CASE WHEN id % 10 = 0 THEN concat('Facture ', id) ELSE '' END text")
    began = time.time()
    got = split_sections_by_line(lines, ["filename"], ["n", "m"]).agg(F.count("*"), F.max("section_no"), F.min("n_sections")).collect()[0]
    assert tuple(got) == (6000, 6000, 6000)
    assert time.time() - began < 30
