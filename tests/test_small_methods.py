"""Text parsing stays in methods that the JVM compiles (8,000 bytes), and tasks
grow in number with the rows."""

import contextlib
import io
import re

from ledgermatch.operators.enrichment import find_value, json_invoice_fields, parse_answer
from ledgermatch.operators.extraction import extract_invoices
from ledgermatch.plans import fixtures as fx
from ledgermatch.sources.lines import parse_statement_lines


def _largest(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("codegen")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())), default=0)


def test_generated_methods_are_compiled(spark):
    docs = spark.createDataFrame([("a.pdf", "Facture N° INV-1\nSOCIETE SUP 1\nTotal TTC : 1,00 EUR")], "filename string, text string")
    answers = spark.createDataFrame([(1, '{"currency":"eur"}')], "k long, answer string")
    lines = spark.createDataFrame([("s", 1, "01/02/2024 VIR 1,00")], "statement_id string, line_no long, line string")
    for df in (extract_invoices(docs), json_invoice_fields(answers), parse_statement_lines(lines)):
        assert _largest(df) < 8000


def test_values_are_found_level_by_level(spark):
    rows = [('{"a":{"k":1},"k":null}',), ('[{"a":[{"b":{"k":2}}]},{"k":3}]',), ('{"a":{"b":{"c":{"d":{"e":{"f":{"k":4}}}}}}}',), ("none",), (None,)]
    df = spark.createDataFrame(rows, "answer string")
    got = df.select(find_value(parse_answer("answer"), "k").cast("string").alias("v")).collect()
    assert [r.v for r in got] == ["1", "2", None, None, None]


def test_tasks_grow_with_the_rows(spark, tmp_path, monkeypatch):
    spark.range(0, 1000).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(fx, "TASK_ROWS", 10)
    df = fx.base(spark, str(tmp_path), "orders", "id")
    assert df.rdd.getNumPartitions() == 100
    assert df.distinct().count() == df.count() == 1000
