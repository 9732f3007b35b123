import datetime as dt
import os
import tempfile
from decimal import Decimal

from ledgermatch.plans.reconcile import load_transactions, reconcile
from ledgermatch.sources.delimited import read_statement_lines
from ledgermatch.sources.documents import read_text_documents


def test_files_end_to_end(spark):
    root = tempfile.mkdtemp(prefix="lm-files-")
    st, inv = os.path.join(root, "statements"), os.path.join(root, "invoices")
    os.makedirs(st)
    os.makedirs(inv)
    with open(os.path.join(st, "bank_a.csv"), "w") as f:
        f.write("Date;Libellé;Montant\r\n05/02/2024;VIR INV-7;-1 234,56\r\n06/02/2024;CB X;-9,99\r\n")
    with open(os.path.join(st, "bank_b.csv"), "w") as f:
        f.write('"Booking Date","Label","Debit","Credit"\n"2024-02-10","VIR INV-8","","88,00"\n')
    with open(os.path.join(inv, "f1.txt"), "w") as f:
        f.write("ACME SARL\nFacture N° INV-7\nDate de facture : 01/02/2024\nTotal TTC : 1 234,56 EUR\n"
                "Facture N° INV-8\nDate de facture : 03/02/2024\nTotal TTC : 88,00 EUR\n")
    lines = read_statement_lines(spark, st)
    assert {r.file_name for r in lines.select("file_name").distinct().collect()} == {"bank_a.csv", "bank_b.csv"}
    assert all(r.statement_id.endswith(r.file_name) and "/statements/" in r.statement_id for r in lines.collect())
    docs = read_text_documents(spark, inv)
    out = reconcile(docs, delimited_lines=lines)
    m = {r.invoice_number: r for r in out["matches"].collect()}
    assert m["INV-7"].matched and m["INV-7"].bank_amount == Decimal("-1234.56")
    assert m["INV-7"].bank_date == dt.date(2024, 2, 5)
    assert m["INV-8"].matched and m["INV-8"].bank_amount == Decimal("88.00")
    s = out["summary"].collect()[0]
    # the "ACME SARL" preamble before the first invoice is a section of its own
    assert (s.invoices, s.invoices_matched, s.transactions, s.transactions_used) == (3, 2, 3, 2)
    flagged = {r.description: r.matched for r in out["transactions"].collect()}
    assert flagged == {"VIR INV-7": True, "CB X": False, "VIR INV-8": True}
    assert out["rejects"].count() == 0


def test_files_of_one_name_stay_apart(spark):
    root = tempfile.mkdtemp(prefix="lm-names-")
    for folder, amount in (("a", "1,00"), ("b", "2,00")):
        os.makedirs(os.path.join(root, folder))
        with open(os.path.join(root, folder, "releve.csv"), "w") as f:
            f.write("Date;Label;Amount\n" + "".join(f"0{d}/02/2024;X{d};{amount}\n" for d in range(1, 10)))
    lines = read_statement_lines(spark, root + "/*")
    tx = load_transactions(delimited_lines=lines)[0].collect()
    assert len(tx) == 18 and len({r.statement_id for r in tx}) == 2
    for sid in {r.statement_id for r in tx}:
        own = sorted((r for r in tx if r.statement_id == sid), key=lambda r: r.row_idx)
        assert [r.description for r in own] == [f"X{d}" for d in range(1, 10)]


def test_answers_and_rejects_of_a_run(spark):
    lines = spark.createDataFrame([("p", 0, "05/01/2024 VIR 1,00"), ("q", 0, "rien"), ("r", 0, "rien")],
                                  "statement_id string, line_no long, line string")
    told = spark.createDataFrame([("q", '{"transactions":[{"date":"2024-01-05","description":"A","amount":1.0E1}]}'),
                                  ("p", '{"transactions":[{"date":"2024-01-05","description":"A","amount":3}]}')],
                                 "statement_id string, answer string")
    tx, rejects = load_transactions(statement_lines=lines, transaction_answers=told)
    assert {(r.statement_id, str(r.amount), r.row_source) for r in tx.collect()} == {("p", "1.00", "lines"), ("q", "10.00", "answers")}
    assert [tuple(r) for r in rejects.collect()] == [("r", "no transaction line")]
