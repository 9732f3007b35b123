import datetime as dt
from decimal import Decimal

from ledgermatch.operators.extraction import extract_invoices, split_sections

SAMPLE = "Facture N° INV-2024-001\nDate de facture : 05/01/2024\nTotal TTC : 1 234,56 EUR"


def test_reference_sample(spark):
    docs = spark.createDataFrame([("facture.pdf", SAMPLE)], "filename string, text string")
    r = extract_invoices(docs).collect()[0]
    assert r.filename == "facture.pdf" and r.section_no == 1
    assert r.invoice_number == "INV-2024-001"
    assert r.invoice_date == dt.date(2024, 1, 5)
    assert r.total_amount == Decimal("1234.56")
    assert r.currency == "EUR" and r.currency_detected
    assert r.header_snippet == SAMPLE.replace("\n", " | ")


def test_sections(spark):
    docs = spark.createDataFrame([
        ("a.pdf", "SOCIETE X\r\nFacture 1\r\nTotal 10,00\r\nFacture 2\r\nTotal 20,00"),
        ("b.pdf", "Facture seule INV-9"),
        ("c.pdf", "Reçu n° 12\nreçu n°13\nx"),
        ("d.pdf", "   \n  "),
    ], "filename string, text string")
    rows = {(r.filename, r.section_no): r.text for r in split_sections(docs).collect()}
    assert rows == {("a.pdf#1", 1): "SOCIETE X", ("a.pdf#2", 2): "Facture 1\nTotal 10,00",
                    ("a.pdf#3", 3): "Facture 2\nTotal 20,00", ("b.pdf", 1): "Facture seule INV-9",
                    ("c.pdf#1", 1): "Reçu n° 12", ("c.pdf#2", 2): "reçu n°13\nx"}


def test_fields_fallbacks(spark):
    docs = spark.createDataFrame([
        ("x.pdf", "ACME SARL\nINVOICE # A-77\nDate: 03-04-2024\nArticle 12,00\nArticle 250,50\nCLIENT DUPONT"),
        ("y.pdf", "rien ici USD"),
    ], "filename string, text string")
    r = {x.filename: x for x in extract_invoices(docs, split=False).collect()}
    x = r["x.pdf"]
    assert (x.invoice_number, x.invoice_date, x.total_amount) == ("A-77", dt.date(2024, 4, 3), Decimal("250.50"))
    assert (x.supplier_name, x.customer_name) == ("ACME SARL", "CLIENT DUPONT")
    y = r["y.pdf"]
    assert (y.invoice_number, y.invoice_date, y.total_amount, y.currency, y.currency_detected) == \
        (None, None, None, "EUR", False)
