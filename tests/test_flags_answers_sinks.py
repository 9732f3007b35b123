import datetime as dt
import glob
import os
import tempfile
from decimal import Decimal

from ledgermatch.operators.enrichment import json_invoice_fields, json_transactions, overlay
from ledgermatch.operators.flags import mark_invoices, mark_transactions, observed_counts, summary_counts
from ledgermatch.plans.reconcile import write_results
from ledgermatch.sinks.writers import invoice_xml_element, invoice_xml_fields, write_invoices_xml

D = dt.date


def test_transaction_flags(spark):
    tx = spark.createDataFrame([("s", 1, D(2024, 1, 2), "VIR A", Decimal("5.00")),
                                ("s", 2, D(2024, 1, 2), "vir  a", Decimal("5.00")),
                                ("s", 3, D(2024, 1, 2), "", Decimal("6.00"))],
                               "statement_id string, row_idx long, date date, description string, amount decimal(18,2)")
    m = spark.createDataFrame([("f", "N", Decimal("5.00"), True, D(2024, 1, 2), Decimal("5.00"), "VIR A"),
                               ("g", "M", Decimal("6.00"), True, D(2024, 1, 2), Decimal("6.00"), " "),
                               ("h", None, None, False, None, None, None)],
                              "filename string, invoice_number string, total_amount decimal(18,2), matched boolean, "
                              "bank_date date, bank_amount decimal(18,2), bank_description string")
    flags = {r.row_idx: r.matched for r in mark_transactions(tx, m).collect()}
    assert flags == {1: True, 2: True, 3: False}
    inv = spark.createDataFrame([("f", " n ", Decimal("5.00")), ("g", "M", Decimal("6.00")), ("h", None, None)],
                                "filename string, invoice_number string, total_amount decimal(18,2)")
    fi = mark_invoices(inv, m)
    assert {r.filename: r.matched for r in fi.collect()} == {"f": True, "g": True, "h": False}
    s = summary_counts(fi, mark_transactions(tx, m)).collect()[0]
    assert tuple(s) == (3, 2, 1, 3, 2)


def test_answers(spark):
    a = spark.createDataFrame([
        ("a", 'Voici {"invoice_number": null, "invoice_date": "2024-02-03", "total_amount": 12.5, "currency": "eur"} ok'),
        ("b", '{"invoice_number": "  ", "invoice_date": "", "total_amount": "1 234,56"}'),
        ("c", "pas de json"), ("d", '{"invoice_number": "X"')], "filename string, answer string")
    p = {r.filename: r for r in json_invoice_fields(a).collect()}
    assert (p["a"].llm_invoice_number, p["a"].llm_invoice_date, p["a"].llm_total_amount, p["a"].llm_currency) == \
        (None, D(2024, 2, 3), Decimal("12.50"), "EUR")
    assert (p["b"].llm_invoice_number, p["b"].llm_invoice_date, p["b"].llm_total_amount) == (None, None, Decimal("1234.56"))
    assert p["c"].llm_invoice_number is None and p["d"].llm_invoice_number is None
    inv = spark.createDataFrame([("a", "H1", D(2024, 1, 1), Decimal("1.00"), "EUR"), ("z", "H2", None, None, "EUR")],
                                "filename string, invoice_number string, invoice_date date, total_amount decimal(18,2), currency string")
    o = {r.filename: r for r in overlay(inv, json_invoice_fields(a)).collect()}
    assert (o["a"].invoice_number, o["a"].invoice_date, o["a"].total_amount) == ("H1", D(2024, 2, 3), Decimal("12.50"))
    assert o["z"].invoice_number == "H2"
    t = spark.createDataFrame([("s", 'x {"transactions": [{"date": "2024-01-05", "description": "A", "amount": -3.5},'
                                     '{"date": "", "description": "B", "amount": 1},'
                                     '{"date": "06/01/2024", "description": "C", "montant": "1 000,00"}]} y')],
                              "statement_id string, answer string")
    got = [(r.row_idx, r.date, r.description, r.amount) for r in json_transactions(t).orderBy("row_idx").collect()]
    assert got == [(0, D(2024, 1, 5), "A", Decimal("-3.50")), (2, D(2024, 1, 6), "C", Decimal("1000.00"))]


def test_xml(spark):
    inv = spark.createDataFrame([("a&b.pdf", None, D(2024, 1, 5), Decimal("12.5"), "EUR")],
                                "filename string, invoice_number string, invoice_date date, total_amount decimal(18,2), currency string")
    f = invoice_xml_fields(inv)
    xml = f.select(invoice_xml_element(f)).collect()[0][0]
    assert xml == ("  <invoice>\n    <filename>a&amp;b.pdf</filename>\n    <invoice_number/>\n"
                   "    <invoice_date>2024-01-05</invoice_date>\n    <total_amount>12.50</total_amount>\n"
                   "    <currency>EUR</currency>\n  </invoice>")
    out = os.path.join(tempfile.mkdtemp(prefix="lm-xml-"), "x")
    write_invoices_xml(inv, out)
    text = "".join(open(p).read() for p in glob.glob(out + "/part-*"))
    assert "<invoices>" in text and "<total_amount>12.50</total_amount>" in text and "a&amp;b.pdf" in text


def test_numbers_depth_and_repeats_of_answers(spark):
    a = spark.createDataFrame([("a", '{"x": {"invoice_number": "N\\"1", "total_amount": 10000000.0}}'), ("b", '{"total_amount": 0.125}'),
                               ("c", '{"total_amount": 1.0E7, "invoice_number": {"v": 1}}'), ("a", '{"currency": "usd"}')],
                              "filename string, answer string")
    p = json_invoice_fields(a)
    got = sorted((r.filename, r.llm_invoice_number, str(r.llm_total_amount)) for r in p.where("llm_total_amount is not null").collect())
    assert got == [("a", 'N"1', "10000000.00"), ("b", None, "0.13"), ("c", None, "10000000.00")]
    inv = spark.createDataFrame([("a", "H1", D(2024, 1, 1), Decimal("1.00"), "EUR")],
                                "filename string, invoice_number string, invoice_date date, total_amount decimal(18,2), currency string")
    rows = overlay(inv, p).collect()
    assert len(rows) == 1 and rows[0].invoice_number == 'N"1'
    t = spark.createDataFrame([("s", '{"transactions": [{"date": "2024-01-05", "description": "A", "amount": 10000000.0}]}')],
                              "statement_id string, answer string")
    assert [r.amount for r in json_transactions(t).collect()] == [Decimal("10000000.00")]


INVOICES = "filename string, path string, invoice_number string, total_amount decimal(18,2)"


def test_files_of_one_name_are_flagged_by_path(spark):
    rows = [("f", "a/f", "N", Decimal("5.00")), ("f", "b/f", "N", Decimal("5.00")), ("f", None, "N", Decimal("5.00"))]
    inv = spark.createDataFrame(rows, INVOICES)
    m = spark.createDataFrame([(*rows[1], True), (*rows[0], False), (*rows[2], True)], INVOICES + ", matched boolean")
    assert {r.path: r.matched for r in mark_invoices(inv, m).collect()} == {"a/f": False, "b/f": True, None: True}
    assert all(r.matched for r in mark_invoices(inv, m.drop("path")).collect())  # one side without paths: by name
    assert all(r.matched for r in mark_invoices(inv.drop("path"), m).collect())


def flagged(spark, n_inv, n_tx):
    return (spark.range(n_inv).selectExpr("concat('f', id) filename", "id % 3 = 0 matched").repartition(3),
            spark.range(n_tx).selectExpr("id row_idx", "id % 4 = 1 matched").repartition(5))


def test_observed_counts_equal_the_summary(spark):
    for n_inv, n_tx in ((100, 57), (1, 0), (0, 0)):
        fi, ft = flagged(spark, n_inv, n_tx)
        want = summary_counts(fi, ft).collect()[0].asDict()
        oi, ot, counts = observed_counts(fi, ft)
        assert oi.columns == fi.columns and len(oi.collect()) == n_inv and len(ot.collect()) == n_tx
        assert counts() == want


def test_results_are_written_with_counts_and_no_second_aggregation(spark):
    fi, ft = flagged(spark, 100, 57)
    folder = tempfile.mkdtemp()
    out = {"invoices": fi, "transactions": ft, "matches": fi.where("matched"), "rejects": ft.limit(0), "summary": summary_counts(fi, ft)}
    row = write_results(out, folder)
    assert row == out["summary"].collect()[0].asDict()
    written = spark.read.parquet(f"{folder}/summary")
    assert written.columns == out["summary"].columns and written.collect()[0].asDict() == row
    assert spark.read.parquet(f"{folder}/invoices").count() == 100 and spark.read.parquet(f"{folder}/transactions").count() == 57
    oi, _, _ = observed_counts(fi, ft)
    plan = oi._jdf.queryExecution().executedPlan().toString()
    assert "CollectMetrics" in plan and "HashAggregate" not in plan
