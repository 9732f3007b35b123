import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgermatch.plans.reconcile import load_transactions, reconcile
from ledgermatch.sources import delimited as D
from ledgermatch.sources.documents import read_text_documents
from ledgermatch.sources.routing import list_files

SCHEMA = "statement_id string, line_no long, line string"


def lines_of(spark, statements):
    return spark.createDataFrame([(k, n, t) for k, v in statements.items() for n, t in enumerate(v)], SCHEMA)


def rows_of(df):
    out = {}
    for r in D.delimited_to_rows(df).orderBy("statement_id", "row_idx").collect():
        out.setdefault(r.statement_id, []).append((r.row_idx, r.cells))
    return out


@pytest.mark.parametrize("run, span", [(1 << 20, 1 << 16), (8, 64)])
def test_reader_equals_the_csv_module(spark, monkeypatch, run, span):
    monkeypatch.setattr(D, "RUN_LINES", run)
    monkeypatch.setattr(D, "RECORD_SPAN", span)
    rng, statements, want = random.Random(1), {}, {}
    for k, sep in enumerate(",;\t|" * 3):
        def field():
            text = rng.choice(["a", 'b 5" c', "", 'q"', "x y", f"two{sep} parts", "line\nbreak", '"said" he', 'a\n\nb"c'])
            if sep in text or "\n" in text or text[:1] == '"' or rng.random() < 0.3:
                text = '"' + text.replace('"', '""') + '"' + rng.choice(["", "", " end"])
            return text
        records = [sep.join(["05/01/2024", field(), field(), "1"]) for _ in range(60)]
        text = sep.join(["Date", "Label", "More", "Amount"]) + "\n" + "\n".join(records)
        name = f"s{k:02d}"
        statements[name] = text.split("\n")
        want[name] = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep)][1:]
    got = rows_of(lines_of(spark, statements))
    assert {k: [[c.strip() for c in r] for _, r in v] for k, v in got.items()} == want


def test_stray_and_unclosed_quotes_lose_nothing(spark):
    body = ['05/01/2024;TUYAU 5" ACIER;1,00', "06/01/2024;A;2,00", '07/01/2024;"open;3,00', "08/01/2024;B;4,00", "", "09/01/2024;C;5,00"]
    got = rows_of(lines_of(spark, {"s": ["Date;Label;Amount"] + body, "n": ["Date;Label;Amount", "05/01/2024;x;1", None]}))
    assert [c for _, c in got["s"]] == [t.replace('"open', '"open').split(";") for t in body if t]
    assert got["n"] == [(1, ["05/01/2024", "x", "1"])]


def test_a_record_over_the_span_is_no_record(spark, monkeypatch):
    monkeypatch.setattr(D, "RECORD_SPAN", 8)
    text = ["Date;Label;Amount", '05/01/2024;"open;1,00'] + [f"0{k}/02/2024;x;1" for k in range(1, 10)] + ['close";1,00', '06/01/2024;"y', 'z";1']
    got = [c for _, c in rows_of(lines_of(spark, {"s": text}))["s"]]
    assert len(got) == 12 and got[-1] == ["06/01/2024", "y\nz", "1"] and got[0][1] == '"open'


def test_separator_by_yield(spark):
    statements = {
        "plain": ["Date;Label;Amount", "05/01/2024;a;1"],
        "comma": ["Date;Libellé, détail;Montant", "05/01/2024;A, b;1,00", "06/01/2024;C;2,00"],
        "pipe": ["Date|Label, more; all|Amount"] + [f"0{k}/01/2024|x;y,z|1" for k in range(1, 10)],
        "late": ["Date,Label,Amount;x"] + ["no;row"] * 5 + ["05/01/2024,a,1;5"],
        "none": ["a;b,c;d", "1;2,3;4"],
        "one": ["nothing", "x"], "blank": ["", " "], "head": ["Date;Label;Amount"]}
    df = lines_of(spark, statements)
    got = {r.statement_id: (r.sep, r.header_no) for r in D.sniff_separator(df).collect()}
    assert got == {"plain": (";", 0), "comma": (";", 0), "pipe": ("|", 0), "late": (",", 0), "none": (",", 0),
                   "one": (None, 0), "head": (";", 0)}
    rejects = {tuple(r) for r in D.delimited_rejects(df).collect()}
    assert rejects == {("one", "no separator"), ("blank", "no separator"), ("head", "no row below the header")}
    assert D.delimited_to_rows(df.limit(0)).count() == 0


def test_long_lines_cost_one_pass(spark):
    hard = ['"' * 60_001, ';"a""' * 20_000, "a;" * 40_000 + '"', '"x' + ' "' * 30_000, " " * 50_000 + '"']
    df = lines_of(spark, {f"s{k}": ["Date;Label;Amount", t, '05/01/2024;b;1'] for k, t in enumerate(hard)})
    assert D.delimited_to_rows(df).where(F.array_contains("cells", "b")).count() >= 3


def test_inventory_accounts_for_every_file(spark, tmp_path):
    files = {"a.csv": "Date;Label;Amount\n05/02/2024;VIR INV-7;12,00\n", "empty.csv": "", "head.csv": "Date;Label;Amount\n",
             "blank.csv": "\n \n", "notes.txt": "Date;Label;Amount\n05/02/2024;VIR INV-9;12,00\n", "none.CSV": "x;y\n1;2\n"}
    st, inv = tmp_path / "st", tmp_path / "inv"
    st.mkdir(), inv.mkdir()
    for name, text in files.items():
        (st / name).write_text(text)
    (inv / "f.txt").write_text("ACME SARL\nFacture N° INV-7\nTotal TTC : 12,00 EUR\n")
    listed = list_files(spark, str(st))
    assert {os.path.basename(r.statement_id): (r.length, r.format) for r in listed.collect()} == {
        n: (len(t), "csv" if n.lower().endswith("csv") else None) for n, t in files.items()}
    out = reconcile(read_text_documents(spark, str(inv)), delimited_lines=D.read_statement_lines(spark, str(st)), files=listed)
    told = {os.path.basename(r.statement_id): r.reason.split(":")[0] for r in out["rejects"].collect()}
    assert told == {"empty.csv": "empty file", "head.csv": "no row below the header", "blank.csv": "no separator",
                    "notes.txt": "unsupported format", "none.CSV": "no date column"}
    assert [r.description for r in out["transactions"].collect()] == ["VIR INV-7"]
    tx, rejects = load_transactions(delimited_lines=D.read_statement_lines(spark, str(st / "head.csv")))
    assert tx.count() == 0 and [r.reason for r in rejects.collect()] == ["no row below the header"]
