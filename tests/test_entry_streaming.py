import os
import tempfile

import __spark_entry__ as E
from ledgermatch.streaming import extract_invoice_stream


def test_contract(spark):
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 40
    df = E.entry(spark)
    assert df.columns[:5] == ["filename", "invoice_number", "invoice_date", "total_amount", "matched"]
    assert df.where("matched").count() > 0


def test_stream_extraction(spark):
    src = tempfile.mkdtemp(prefix="lm-stream-")
    with open(os.path.join(src, "a.txt"), "w") as f:
        f.write("Facture N° INV-1\nTotal TTC : 10,00 EUR\nFacture N° INV-2\nTotal TTC : 20,00 EUR")
    s = extract_invoice_stream(spark, src)
    q = s.writeStream.format("memory").queryName("lm_stream_test").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.filename, r.invoice_number) for r in spark.sql("SELECT * FROM lm_stream_test").collect()}
    assert got == {("a.txt#1", "INV-1"), ("a.txt#2", "INV-2")}


def test_stream_needs_a_lasting_folder(spark, monkeypatch):
    import pytest
    from ledgermatch.streaming import extract_stream
    s = extract_invoice_stream(spark, tempfile.mkdtemp(prefix="lm-stream-"))
    monkeypatch.setattr(extract_stream, "shared_root", lambda _: None)
    with pytest.raises(ValueError):
        extract_stream.start_invoice_stream(s, tempfile.mkdtemp())
    root = tempfile.mkdtemp()
    monkeypatch.setattr(extract_stream, "shared_root", lambda _: root)
    extract_stream.start_invoice_stream(s, tempfile.mkdtemp(), "a").stop()
    assert os.listdir(root) == ["stream-a"]
