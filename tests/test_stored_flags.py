"""Flag joins of stored tables: the flags of the plain joins, and no shuffle."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from ledgermatch.operators import flags as FL, stored as ST


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    day = dt.date(2024, 1, 1)
    tx = [(f"s{i % 3}", i, day if i % 2 else day + dt.timedelta(rng.randint(0, 5)), f" Vir {rng.randint(0, 6)} ", Decimal(rng.randint(1, 4)))
          for i in range(400)] + [("s9", 400 + i, day, "abo", Decimal("9.99")) for i in range(600)] + [("s9", 2000, None, None, None)]
    tx = spark.createDataFrame(tx, "statement_id string, row_idx long, date date, description string, amount decimal(18,2)")
    m = [(f"f{i % 9}", None if i % 4 == 0 else f"/p{i % 2}", f"N{i}", Decimal(i), i % 3 > 0, day, Decimal(i % 5), f"vir{i % 7}") for i in range(60)] \
        + [("f1", "/p1", "A", Decimal(5), True, day, Decimal("9.99"), "ABO"), ("f1", None, None, None, True, None, None, "x")]
    m = spark.createDataFrame(m, "filename string, path string, invoice_number string, total_amount decimal(18,2), matched boolean, "
                                 "bank_date date, bank_amount decimal(18,2), bank_description string")
    return tx, m, m.select("filename", "path", "invoice_number", "total_amount").unionByName(
        m.limit(9).selectExpr("filename", "'/other' AS path", "invoice_number", "total_amount"))


def _rows(df):
    return sorted(map(repr, (tuple(r) for r in df.select(sorted(df.columns)).collect())))


@pytest.mark.parametrize("salts", [1, 4])
def test_flags_equal_the_plain_joins_without_a_shuffle(spark, tables, tmp_path, salts):
    tx, m, inv = tables
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = ST.store_transactions(tx, f"t_{salts}", 8, salts, str(tmp_path / "t"))
        used = ST.store_used_transactions(m, f"u_{salts}", 8, salts, str(tmp_path / "u"))
        files = {by: (ST.store_invoices(inv, f"i_{salts}_{by}", 8, salts, by, str(tmp_path / f"i{by}")),
                      ST.store_matched_invoices(m, f"j_{salts}_{by}", 8, salts, by, str(tmp_path / f"j{by}"))) for by in (False, True)}
        pairs = [(ST.flag_stored(kept, used), FL.mark_transactions(tx, m)), (ST.unused_stored(kept, used), FL.unused_transactions(tx, m)),
                 (ST.flag_stored(*files[True]), FL.mark_invoices(inv, m)), (ST.flag_stored(*files[False]), FL.mark_invoices(inv, m.drop("path")))]
        for got, want in pairs:
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "SortMergeJoin" in plan
            assert _rows(got) == _rows(want)
        assert {r.matched for r in pairs[0][0].collect()} == {True, False}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_a_hot_key_is_dealt_over_buckets(spark, tables, tmp_path):
    from pyspark.sql import functions as F
    kept = ST.store_transactions(tables[0], "t_hot", 16, 8, str(tmp_path / "hot"))
    per_file = [r["count"] for r in kept.where("description = 'abo'").groupBy(F.input_file_name()).count().collect()]
    assert len(per_file) > 3 and sum(per_file) == 600


def test_empty_tables(spark, tables, tmp_path):
    tx, m, _ = tables
    kept = ST.store_transactions(tx.limit(0), "t_none", 4, 2, str(tmp_path / "a"))
    used = ST.store_used_transactions(m.limit(0), "u_none", 4, 2, str(tmp_path / "b"))
    assert ST.flag_stored(kept, used).count() == 0 and ST.unused_stored(kept, used).count() == 0
