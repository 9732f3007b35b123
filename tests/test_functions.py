import datetime as dt
from decimal import Decimal

from helpers import one_col
from pyspark.sql import functions as F

from ledgermatch.functions import (is_entity_line, json_block, levenshtein_score, parse_amount,
                                   parse_date, standardize_header, strip_accents)
from ledgermatch.functions.similarity import jaro_winkler_py, partial_ratio_py


def test_parse_date_reference_cases(spark):
    cases = {"01/01/2023": dt.date(2023, 1, 1), "2023-01-01": dt.date(2023, 1, 1),
             "1 Jan 2023": dt.date(2023, 1, 1), "Not a date": None,
             "05/12/2024": dt.date(2024, 12, 5), "15 janvier 2023": dt.date(2023, 1, 15)}
    assert one_col(spark, list(cases), parse_date) == list(cases.values())


def test_parse_date_own_cases(spark):
    cases = {"2024-01-05": dt.date(2024, 1, 5), "5/1/24": dt.date(2024, 1, 5), "31/02/2024": None,
             "15 février 2023": dt.date(2023, 2, 15), "1 août 2023": dt.date(2023, 8, 1), "12": None,
             "1er mai 2024": dt.date(2024, 5, 1), "January 5, 2023": dt.date(2023, 1, 5),
             "05.01.2024": dt.date(2024, 1, 5), "2024-01-05 00:00:00": dt.date(2024, 1, 5),
             "32/01/2024": None, "05/13/2024": None, "": None, "5/1/202": None}
    assert one_col(spark, list(cases), parse_date) == list(cases.values())


def test_parse_date_after_a_weekday(spark):
    cases = {"Monday 5 February 2024": dt.date(2024, 2, 5), "lundi 5 février 2024": dt.date(2024, 2, 5),
             "Lundi, le 1er mai 2024": dt.date(2024, 5, 1), "Mon, 05 Feb 2024": dt.date(2024, 2, 5),
             "Thu. Jan 15, 2023": dt.date(2023, 1, 15), "mar 15, 2024": dt.date(2024, 3, 15), "sam.3 juin 2024": None,
             "Monday": None, "lundi mardi 5 mai 2024": None, "mon" + " " * 100_000 + "x": None, "Sunday 31 June 2024": None}
    assert one_col(spark, list(cases), parse_date) == list(cases.values())


def test_parse_amount_reference_cases(spark):
    cases = {"1,234.56": Decimal("1234.56"), "1.234,56": Decimal("1234.56"), "1 234,56": Decimal("1234.56"),
             "100": Decimal("100.00"), "-50.25": Decimal("-50.25"), "Not a number": None,
             "+ 987,00": Decimal("987.00"), None: None}
    assert one_col(spark, list(cases), parse_amount) == list(cases.values())


def test_parse_amount_own_cases(spark):
    cases = {"1234,56": Decimal("1234.56"), "12.5": Decimal("12.50"), "0,5": Decimal("0.50"),
             "1 234 567,89": Decimal("1234567.89"), "1 234,56": Decimal("1234.56"),
             "1234567.8": Decimal("1234567.80"), "": None, "   ": None, "Total : 1 234,56 EUR": Decimal("1234.56"),
             "99999999999999999999": None}
    assert one_col(spark, list(cases), parse_amount) == list(cases.values())


def test_strip_accents_and_headers(spark):
    assert one_col(spark, ["Libellé", "Crédit", "Straße", "éte"], strip_accents) == \
        ["Libelle", "Credit", "Straße", "ete"]
    assert one_col(spark, [" Date  opération ", "Débit/Crédit", None], standardize_header) == \
        ["date operation", "debit credit", ""]


def test_entity_lines(spark):
    assert one_col(spark, ["SOCIETE SUP 1", "Facture N° 1", "AB", "1234", "Total TTC : 12 EUR"],
                   is_entity_line) == [True, False, False, False, True]


def test_levenshtein_score_reference_case(spark):
    df = spark.createDataFrame([("INV-123", "Paiement INV-123"), (None, "x"), ("  ", "x")], "a string, b string")
    got = [r[0] for r in df.select(levenshtein_score("a", "b")).collect()]
    assert got == [43.75, 0.0, 0.0]


def test_json_block(spark):
    got = one_col(spark, ['Voici : {"a": {"b": 1}} fin', "rien", None], json_block)
    assert got == ['{"a": {"b": 1}}', None, None]


def test_similarity_helpers():
    assert round(jaro_winkler_py("debit", "debit credit"), 4) == 0.8833
    assert round(jaro_winkler_py("martha", "marhta"), 4) == 0.9611
    assert jaro_winkler_py("", "date") == 0.0
    assert partial_ratio_py("inv-123", "paiement inv-123") == 100.0
    assert partial_ratio_py("paiement inv-123", "inv-123") == 100.0
    assert 0 < partial_ratio_py("inv-124", "paiement inv-123") < 100
    assert partial_ratio_py("", "abc") == 0.0


def test_plain_numbers_are_numbers(spark):
    cases = {"0.125": Decimal("0.13"), "12.345": Decimal("12345.00"), "1.0E7": Decimal("10000000.00"), "10000000.0": Decimal("10000000.00"),
             "12345678.9": Decimal("12345678.90"), "-2.5e-1": Decimal("-0.25"), "1.234,56": Decimal("1234.56"),
             "Total 12.345 EUR": Decimal("12345.00"), "1.234.567": Decimal("1234567.00")}
    assert one_col(spark, list(cases), parse_amount) == list(cases.values())


def test_more_date_forms(spark):
    cases = {"15-Jan-2024": dt.date(2024, 1, 15), "2024-01-05T10:00:00": dt.date(2024, 1, 5), "20240105": dt.date(2024, 1, 5),
             "2024-01-05T10:00:00.5Z": dt.date(2024, 1, 5), "15 janv. 24": dt.date(2024, 1, 15), "20241305": None, "123456789": None}
    assert one_col(spark, list(cases), parse_date) == list(cases.values())


def test_blank_runs_stay_linear(spark):
    import time
    from ledgermatch.functions import invoice_fields as IF
    from ledgermatch.functions.text import ktrim
    gap = " " * 100_000
    df = spark.createDataFrame([("a" + gap + "b",), ("facture" + gap + "!",), ("date" + gap + "x",), (gap + "7,00",)], "t string")
    start = time.time()
    rows = df.select(ktrim("t").alias("a"), IF.find_invoice_number("t").alias("b"), IF.find_invoice_date("t").alias("c"),
                     parse_amount("t").alias("d"), IF.text_max_amount("t").alias("e")).collect()
    assert time.time() - start < 30
    assert len(rows[0].a) == 100_002 and rows[3].d == Decimal("7.00") and rows[3].a == "7,00"


def test_partial_ratio_below_100():
    assert round(partial_ratio_py("abcd", "xxabzdyy"), 4) == 75.0
    assert round(partial_ratio_py("inv-123", "paiement inv-124"), 4) == 85.7143
    assert partial_ratio_py("ab", "cd") == 0.0 and round(partial_ratio_py("abc", "bc"), 4) == 100.0
    assert round(partial_ratio_py("this is", "that was it"), 4) == round(partial_ratio_py("that was it", "this is"), 4)


def test_partial_ratio_column(spark):
    from ledgermatch.functions.similarity import partial_ratio
    df = spark.createDataFrame([("INV-1", "x inv-1 y"), ("abcd", "xxabzdyy"), (None, "a"), ("a", None), ("", "a")], "a string, b string")
    assert [r[0] for r in df.select(partial_ratio("a", "b")).collect()] == [100.0, 75.0, 0.0, 0.0, 0.0]
