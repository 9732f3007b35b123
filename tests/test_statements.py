import datetime as dt
from decimal import Decimal

from ledgermatch.operators.columns import detect_columns, resolve_suggested_column
from ledgermatch.operators.statements import (filter_valid, grid_rejects, grid_to_rows, harmonise, load_statements,
                                              reject_report)
from ledgermatch.sources.delimited import delimited_rejects, delimited_to_rows
from ledgermatch.sources.lines import parse_statement_lines


def layouts(spark, lists):
    return spark.createDataFrame([(h,) for h in lists], "headers array<string>")


def test_detect_columns(spark):
    lists = [["Date", "Libellé", "Montant"], ["Booking Date", "Label", "Débit", "Crédit"],
             ["Date opération", "Description", "Amount", "Solde"], ["Date", "Libellé", "Solde"],
             ["Date", "Détails", "Débit/Crédit"], ["Libellé", "Montant"], ["Date", "Montant"],
             ["Date valeur", "Narration details", "Montant EUR"], ["Date", "Narration", "Amount", "Debit", "Credit"]]
    got = {tuple(r.headers): (r.date_idx, r.description_idx, r.amount_idx, r.debit_idx, r.credit_idx,
                              r.reject_reason) for r in detect_columns(layouts(spark, lists)).collect()}
    assert got[("Date", "Libellé", "Montant")] == (0, 1, 2, None, None, None)
    assert got[("Booking Date", "Label", "Débit", "Crédit")] == (0, 1, None, 2, 3, None)
    assert got[("Date opération", "Description", "Amount", "Solde")] == (0, 1, 2, None, None, None)
    assert got[("Date", "Libellé", "Solde")] == (0, 1, 2, None, None, None)
    assert got[("Date", "Détails", "Débit/Crédit")] == (0, 1, 2, None, None, None)
    assert got[("Date", "Narration", "Amount", "Debit", "Credit")] == (0, 1, 2, 3, 4, None)
    assert got[("Libellé", "Montant")][5] == "no date column"
    assert got[("Date", "Montant")][5] == "no description column"
    assert got[("Date valeur", "Narration details", "Montant EUR")] == (0, 1, 2, None, None, None)


def test_resolve_suggested(spark):
    df = spark.createDataFrame([(["Date", "Libellé", "Montant"], "libelle"), (["Date", "Libellé", "Montant"], "Montant EUR"),
                                (["Date", "Libellé", "Montant"], "xyz"), (["Date", "Libellé", "Montant"], None)],
                               "headers array<string>, suggested string")
    got = [r.resolved for r in resolve_suggested_column(df).orderBy("suggested").collect()]
    assert sorted(got, key=str) == sorted(["Libellé", "Montant", None, None], key=str)


def test_grid_header_and_sign_rule(spark):
    grid = spark.createDataFrame([
        ("g", 0, ["RELEVE", "", ""]), ("g", 1, ["Date", "Label", "Débit", "Crédit"]),
        ("g", 2, ["01/02/2024", "VIR A", "12,50", ""]), ("g", 3, ["02/02/2024", "VIR B", "", "7,00"]),
        ("g", 4, ["03/02/2024", "VIR C"]), ("g", 5, ["04/02/2024", "  ", "1,00", ""]),
        ("late", 0, ["x"]), ("late", 1, ["x"]), ("late", 2, ["x"]), ("late", 3, ["x"]), ("late", 4, ["x"]),
        ("late", 5, ["Date", "Libellé", "Montant"]), ("late", 6, ["01/01/2024", "Y", "1"]),
        ("h4", 4, ["Date", "Libellé", "Montant"]), ("h4", 5, ["01/01/2024", "Z", "2,00"]),
    ], "statement_id string, row_idx long, cells array<string>")
    rows = grid_to_rows(grid)
    assert {r.statement_id for r in rows.collect()} == {"g", "h4", "late"}
    bare = spark.createDataFrame([("bare", 0, ["x"]), ("bare", 1, ["", "y"])], grid.schema)
    assert [tuple(r) for r in grid_rejects(grid.unionByName(bare)).collect()] == [("bare", "no header row")]
    h = harmonise(rows)
    tx = {r.row_idx: (r.date, r.description, r.amount) for r in filter_valid(h).where("statement_id = 'g'").collect()}
    assert tx == {2: (dt.date(2024, 2, 1), "VIR A", Decimal("-12.50")), 3: (dt.date(2024, 2, 2), "VIR B", Decimal("7.00"))}
    rep = {r.statement_id: r for r in reject_report(h).collect()}["g"]
    assert (rep.rows_in, rep.rows_kept, rep.dropped_no_amount, rep.dropped_no_description) == (4, 2, 1, 1)


def test_delimited_sniffing(spark):
    text = ['', 'Date,Libellé,Montant', '01/01/2024,"VIR ""A"", B","1 234,56"', '02/01/2024,C,-5,00']
    semi = ['Date;Libellé;Montant', '01/01/2024;D;3,00']
    lines = spark.createDataFrame([("c", i, l) for i, l in enumerate(text)] +
                                  [("s", i, l) for i, l in enumerate(semi)],
                                  "statement_id string, line_no long, line string")
    tx = {(r.statement_id, r.row_idx): (r.description, r.amount)
          for r in load_statements(delimited_to_rows(lines)).collect()}
    assert tx[("c", 2)] == ('VIR "A", B', Decimal("1234.56"))
    assert tx[("s", 1)] == ("D", Decimal("3.00"))
    # an unquoted decimal comma in a comma file splits the cell: '-5' and '00'
    assert tx[("c", 3)] == ("C", Decimal("-5.00"))


def test_statement_lines(spark):
    lines = spark.createDataFrame([
        ("p", 0, "05/01/2024 VIR INV-123 100,00"), ("p", 1, "06/01/2024 FACT 2024 100,00"),
        ("p", 2, "07/01/2024 VIR 1 234,56"), ("p", 3, "SOLDE 1 000,00"), ("p", 4, "08/01/2024 PAS DE MONTANT"),
        ("p", 5, "  09/01/2024 RETRAIT -20,00  ")], "statement_id string, line_no long, line string")
    got = {r.row_idx: (r.description, r.amount) for r in parse_statement_lines(lines).collect()}
    assert got == {0: ("VIR INV-123", Decimal("100.00")), 1: ("FACT 2024", Decimal("100.00")),
                   2: ("VIR", Decimal("1234.56")), 5: ("RETRAIT", Decimal("-20.00"))}


def test_blank_amount_falls_back_to_debit_and_credit(spark):
    h = ["Date", "Narration", "Amount", "Debit", "Credit"]
    rows = spark.createDataFrame([("s", 1, h, ["01/02/2024", "A", "3,00", "9,00", ""]), ("s", 2, h, ["01/02/2024", "B", "", "4,00", ""]),
                                  ("s", 3, h, ["01/02/2024", "C", "x", "0,00", "5,00"])],
                                 "statement_id string, row_idx long, headers array<string>, cells array<string>")
    assert {r.row_idx: r.amount for r in load_statements(rows).collect()} == {1: Decimal("3.00"), 2: Decimal("-4.00"), 3: Decimal("5.00")}


def test_resolve_keeps_every_row(spark):
    df = spark.createDataFrame([(["Date", "Montant"], "date"), (["Date", "Montant"], "date"), ([], "date"), (None, "x"),
                                (["Date"], None)], "headers array<string>, suggested string")
    got = sorted((r.resolved for r in resolve_suggested_column(df).collect()), key=str)
    assert got == ["Date", "Date", None, None, None]


def test_suggestions_read_unknown_headers(spark):
    h = ["c1", "c2", "c3"]
    rows = spark.createDataFrame([("s", 1, h, ["01/02/2024", "A", "3,00"]), ("t", 1, h, ["01/02/2024", "A", "3,00"])],
                                 "statement_id string, row_idx long, headers array<string>, cells array<string>")
    told = spark.createDataFrame([("s", "C1", "c2", "C3s", None, None)] * 2 + [("t", "zzzz", "c2", "c3", None, None)],
                                 "statement_id string, date_column string, description_column string, amount_column string, "
                                 "debit_column string, credit_column string")
    got = {r.statement_id: r.reject_reason for r in harmonise(rows, suggestions=told).collect()}
    assert got == {"s": None, "t": "no date column"}


def test_lines_with_no_break_blanks_and_english_amounts(spark):
    texts = ["05/01/2024 VIR 1,234.56", "05/01/2024 VIR 1\u00a0234,56", "05/01/2024 VIR\u001fX 1\u202f234,56", "05/01/2024 VIR 0.125"]
    lines = spark.createDataFrame([("p", k, t) for k, t in enumerate(texts)], "statement_id string, line_no long, line string")
    got = {r.row_idx: (r.description, r.amount) for r in parse_statement_lines(lines).collect()}
    assert {k: v[1] for k, v in got.items() if k < 3} == {k: Decimal("1234.56") for k in range(3)}
    assert got[2][0] == "VIR\u001fX"


def test_quoted_line_breaks_and_wide_lines(spark):
    wide = "Date,Label,Amount" + ",x" * 5000
    rows = [("m", 0, "Date;Label;Amount"), ("m", 1, '01/02/2024;"VIR'), ("m", 2, "two"), ("m", 3, ' lines; ""x""";3,00'),
            ("m", 4, "02/02/2024;B;4,00"), ("w", 0, wide), ("w", 1, '"01/02/2024","a, b","1,00"' + ',"q"' * 5000), ("e", 0, " "), ("n", 0, "one")]
    lines = spark.createDataFrame(rows, "statement_id string, line_no long, line string")
    got = {(r.statement_id, r.row_idx): (r.description, r.amount) for r in load_statements(delimited_to_rows(lines)).collect()}
    assert got == {("m", 1): ('VIR\ntwo\n lines; "x"', Decimal("3.00")), ("m", 4): ("B", Decimal("4.00")),
                   ("w", 1): ("a, b", Decimal("1.00"))}
    assert sorted(r.statement_id for r in delimited_rejects(lines).collect()) == ["e", "n"]
