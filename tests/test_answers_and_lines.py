import random
import re
import time
from decimal import Decimal

from helpers import one_col
from pyspark.sql import functions as F

from ledgermatch.functions.amounts import number_amount, parse_amount
from ledgermatch.functions.similarity import jaro_winkler_py
from ledgermatch.operators.enrichment import json_invoice_fields, json_transactions
from ledgermatch.sources.lines import parse_statement_lines


def test_a_lone_dot_and_three_digits_are_a_group_in_text(spark):
    cases = {"1.234": "1234.00", "12.345": "12345.00", "-1.500": "-1500.00", "1.234 EUR": "1234.00", "1.234.567": "1234567.00",
             "0.125": "0.13", "1.2345": "1.23", "1234.567": "1234.57", "12.5": "12.50", "1.0E7": "10000000.00", "999.999": "999999.00",
             "-0.004": "0.00", " 1.234 ": "1234.00", ".125": "0.13"}
    assert one_col(spark, list(cases), parse_amount) == [Decimal(v) for v in cases.values()]
    numbers = spark.createDataFrame([(1.234,), (0.005,), (-2.675,), (1e30,), (None,)], "x double")
    assert [r[0] for r in numbers.select(number_amount("x")).collect()] == [Decimal("1.23"), Decimal("0.01"), Decimal("-2.68"), None, None]


def test_answers_keep_numbers_and_texts_apart(spark):
    cases = [
        ('ok {"invoice_number":"A-1","total_amount":"1.234","invoice_date":"05/01/2024","currency":"eur"}.', ("A-1", "1234.00", "EUR")),
        ('{"total_amount":1.234,"invoice_number":12}', ("12", "1.23", None)),
        ('{"result":{"invoice":{"total_amount":1.5e3,"invoice_number":null}},"note":"the \\"invoice_number\\": \\"X9\\" key"}', (None, "1500.00", None)),
        ('{"items":[{"total_amount":"12,50"},{"total_amount":3}],"invoice_number":{"a":1},"currency":" "}', (None, "12.50", None)),
        ('{"a":{"total_amount":1},"total_amount":2}', (None, "2.00", None)),
        ('{"total_amount":true}', (None, None, None)), ("{bad json", (None, None, None)), ("none", (None, None, None)), (None, (None, None, None)),
        ('{"total_amount":123456789012345678901234567890}', (None, None, None)), ('[{"total_amount":7}]', (None, "7.00", None))]
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(cases)], "k int, answer string")
    got = json_invoice_fields(df).orderBy("k").collect()
    assert [(r.llm_invoice_number, r.llm_total_amount and str(r.llm_total_amount), r.llm_currency) for r in got] == [w for _, w in cases]


def test_transactions_of_answers_by_type(spark):
    item = '{{"date":"05/01/2024","description":"{0}",{1}}}'
    told = '{"transactions":[' + ",".join([item.format("a", '"amount":1.234'), item.format("b", '"amount":"1.234"'), item.format(" ", '"amount":1'),
                                           item.format("d", '"amount":null,"montant":"7,5"'), item.format("e", '"amount_text":"-1 000,00"'), "5", "null",
                                           item.format("f", '"amount":[1]')]) + "]}"
    df = spark.createDataFrame([("s", told), ("t", '{"transactions":{}}'), ("u", '{"transactions":null}'), ("v", None), ("w", "x")],
                               "statement_id string, answer string")
    got = [(r.statement_id, r.row_idx, r.description, str(r.amount)) for r in json_transactions(df).orderBy("row_idx").collect()]
    assert got == [("s", 0, "a", "1.23"), ("s", 1, "b", "1234.00"), ("s", 3, "d", "7.50"), ("s", 4, "e", "-1000.00")]


def plain_line(line):
    """The line grammar as one backtracking pattern: the shortest description after which an amount ends the line."""
    m = re.match(r"^\s*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\s+(?:(.*?)\s)??([+-]?\s?(?:\d{1,3}(?:[ .,]\d{3})+(?!\d)|\d+)(?:[.,]\d{1,2})?)\s*$", line)
    return m and (m[2] or "", m[3])


def test_line_scan_equals_the_backtracking_pattern(spark):
    rng = random.Random(5)
    lines = ["05/01/2024 " + "".join(rng.choice(["1", "23", "456", "789", " ", " ", ".", ",", "-", "+", "a", "INV-", "00"]) for _ in range(rng.randint(1, 9)))
             for _ in range(3000)] + ["05/01/2024 12", "05/01/2024", "5-1-24 x 1 234,50 ", " 05/01/2024 VIR - 100,00", "a 05/01/2024 1"]
    rows = parse_statement_lines(spark.createDataFrame([("s", k, t) for k, t in enumerate(lines)], "statement_id string, line_no long, line string")).collect()
    want = {k: plain_line(t) for k, t in enumerate(lines) if plain_line(t)}
    values = dict(zip(want, one_col(spark, [a for _, a in want.values()], parse_amount)))
    assert {r.row_idx: (r.description, r.amount) for r in rows} == {k: (d.strip(), values[k]) for k, (d, _) in want.items() if values[k] is not None}


def test_long_lines_are_scanned_in_linear_time(spark):
    n = 20_000
    lines = ["05/01/2024 " + "123 " * n, "05/01/2024 " + "1 " * n + "x", "05/01/2024 x " + "1234 " * n + "5", "05/01/2024 a" + "123 " * n + "b 1",
             "05/01/2024 x" + ".123" * n, "05/01/2024 " + " " * n + "7,5"]
    df = spark.createDataFrame([("s", k, t) for k, t in enumerate(lines)], "statement_id string, line_no long, line string")
    parse_statement_lines(df.limit(1)).collect()
    start = time.time()
    got = {r.row_idx: str(r.amount) for r in parse_statement_lines(df).collect()}
    assert got == {2: "5.00", 3: "1.00", 5: "7.50"} and time.time() - start < 10


def test_jaro_winkler_counts_whole_transpositions():
    assert abs(jaro_winkler_py("dates 26", "credit") - 0.5138888888888888) < 1e-12
    assert abs(jaro_winkler_py("martha", "marhta") - 0.9611111111111111) < 1e-12 and jaro_winkler_py("a", "b") == 0.0
