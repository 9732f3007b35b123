"""What several outputs read is made once."""

import datetime

from ledgermatch.plans.reconcile import load_transactions
from ledgermatch.plans.registry import QUERIES


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_summary_counts_matches_once(spark, tmp_path):
    day = datetime.datetime(2024, 1, 5)
    spark.createDataFrame([(1, 1, day, 10.0), (2, 2, day, 20.0), (3, 3, day, 30.0)],
                          "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double") \
        .coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    df = QUERIES["summary_counts"](spark, str(tmp_path))
    assert "levenshtein" not in _plan(df)  # stood there for each flag join
    assert df.collect()[0].asDict() == {"invoices": 3, "invoices_matched": 2, "invoices_unmatched": 1,
                                        "transactions": 3, "transactions_used": 2}


def test_lines_are_parsed_once(spark):
    rows = spark.createDataFrame([("g", 1, ["Date", "Label", "Amount"], ["05/01/2024", "A", "1,00"])],
                                 "statement_id string, row_idx long, headers array<string>, cells array<string>")
    lines = spark.createDataFrame([("g", 1, "05/01/2024 A 1,00"), ("g", 2, "06/01/2024 B 2,00"), ("x", 1, "none")],
                                  "statement_id string, line_no long, line string")
    told = spark.createDataFrame([("y", '{"transactions":[{"date":"2024-01-05","description":"C","amount":3}]}'), ("z", "{}")],
                                 "statement_id string, answer string")
    tx, rejects = load_transactions(rows, statement_lines=lines, transaction_answers=told)
    assert "regexp" not in _plan(tx) and "regexp" not in _plan(rejects)  # parsed again for each before
    assert sorted((r.statement_id, r.description, r.row_source) for r in tx.collect()) == [
        ("g", "A", "grid"), ("g", "B", "lines"), ("y", "C", "answers")]
    assert [tuple(r) for r in rejects.collect()] == [("x", "no transaction line")]
