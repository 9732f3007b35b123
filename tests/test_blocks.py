"""Pairs are made block by block: the same as brute force, never rows that are shuffled."""

import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgermatch.functions.pair_scores import levenshtein_pairs
from ledgermatch.operators import matching as M
from ledgermatch.plans.registry import QUERIES

INV = "filename string, invoice_number string, invoice_date date, total_amount decimal(18,2), customer string"
TXN = "statement_id string, row_idx long, date date, description string, amount decimal(18,2), customer string"
DAY = dt.date(2024, 1, 1)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def tables(spark, n=220, m=700, seed=3):
    rnd = random.Random(seed)
    text = lambda k: "".join(rnd.choice("aB1é中-") for _ in range(k))
    # few amounts and names: hot cells of several blocks, and names whose rows lie in several cells
    invs = [(rnd.choice([None, *(f"i{j}" for j in range(150))]), rnd.choice([None, " ", text(rnd.randint(1, 9)), text(70)]),
             None if k % 9 == 0 else DAY + dt.timedelta(rnd.randint(0, 900)),
             None if k % 13 == 0 else Decimal(rnd.choice([100, 101, 250, -250, 99999]) + rnd.randint(0, 3)) / 100,
             rnd.choice(["x", "x", None])) for k in range(n)]
    txns = [(rnd.choice(["s", "t", None]), rnd.randint(0, 40), None if k % 29 == 0 else DAY + dt.timedelta(rnd.randint(0, 1000)),
             rnd.choice([None, "", text(rnd.randint(1, 30))]),
             None if k % 31 == 0 else Decimal(rnd.choice([100, 101, 250, -250, 99999]) + rnd.randint(-3, 3)) / 100,
             rnd.choice(["x", "x", None])) for k in range(m)]
    return spark.createDataFrame(invs, INV), spark.createDataFrame(txns, TXN), invs, txns


def pairs(invs, txns, tol, days, keyed):
    for k, (name, number, day, total, who) in enumerate(invs):
        for sid, row, when, text, amount, whose in txns:
            if None in (total, amount, when) or abs(abs(amount) - abs(total)) * 100 > tol or keyed and (who is None or who != whose):
                continue
            if day is None or 0 <= (when - day).days <= days:
                a, b = (number or "").lower(), (text or "").lower()
                score = 100.0 * (1.0 - distance(a, b) / max(len(a), len(b))) if a.strip(" ") else 0.0
                yield k, name, score + (5.0 if abs(amount) == abs(total) else 0.0), when, row, sid, amount, text


def test_levenshtein_of_pairs():
    rnd = random.Random(1)
    for letters in ("ab1", "abcé中😀"):
        a, b = (["".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 5, 12, 22, 40]))) for _ in range(40)] + [letters * 60]
                for _ in range(2))
        left, right = np.repeat(np.arange(41), 41), np.tile(np.arange(41), 41)
        far, longest = levenshtein_pairs(pa.array(a), pa.array(b), left, right)
        assert [*far] == [distance(a[i], b[j]) for i, j in zip(left, right)]
        assert [*longest] == [max(len(a[i]), len(b[j])) for i, j in zip(left, right)]


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("tol,days", [(0, 0), (0.03, 90)])
def test_candidates_equal_brute_force(spark, tol, days, keyed):
    inv, txn, invs, txns = tables(spark)
    c = M.candidates(inv, txn, tol, days, keys=["customer"] if keyed else [])
    got = sorted(((r.filename, r.match_score, r.bank_date, r.bank_row_idx, r.bank_statement_id, Decimal(r.bank_cents) / 100,
                   r.bank_description) for r in c.collect()), key=repr)
    assert got == sorted((p[1:] for p in pairs(invs, txns, int(tol * 100), days, keyed)), key=repr)
    # they were scored row by row, in a string function of 2 us, before
    assert "levenshtein(" not in c._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("order", ["date", "row"])
def test_match_equals_brute_force(spark, order):
    inv, txn, invs, txns = tables(spark, seed=5)
    first = lambda *key: tuple((v is not None, v) for v in key)
    best, count = {}, {}
    for k, _, score, when, row, sid, amount, text in pairs(invs, txns, 3, 90, False):
        rank = first(-score, *((when, row, sid) if order == "date" else (sid, row, when)), amount, text)
        count[k] = count.get(k, 0) + 1
        if k not in best or rank < best[k][0]:
            best[k] = rank, (score, when, amount, text, sid, row)
    want = [(name, number, day, total, best[k][1] if k in best else None, count.get(k, 0))
            for k, (name, number, day, total, _) in enumerate(invs)]
    got = [(r.filename, r.invoice_number, r.invoice_date, r.total_amount,
            (r.match_score, r.bank_date, r.bank_amount, r.bank_description, r.bank_statement_id, r.bank_row_idx) if r.matched else None,
            r.n_candidates) for r in M.match(inv, txn, 0.03, 90, tie_order=order).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_placed_ranks_equal_the_others(spark):
    inv, txn, _, _ = tables(spark, seed=7)
    plain = M.rank_candidates(M.candidates(inv, txn, 0.03, 90))
    placed = M.rank_candidates(M.candidates(inv, txn, 0.03, 90, placed=True))
    assert placed.columns == plain.columns
    # equal rows of one name take turns, so their ranks are compared as rows
    rows = lambda df: sorted((tuple(r) for r in df.withColumn("match_score", F.round("match_score", 9)).collect()), key=repr)
    assert plain.where("rank > 1").count() > 500 and rows(placed) == rows(plain)


def test_argmax_makes_no_pair_rows(spark):
    """1,000 numbered invoices x 20,000 payments of one amount: the min_by reads one row per invoice and block (before: per pair)."""
    inv = spark.range(1000).selectExpr("concat('i', id) filename", "concat('N', id) invoice_number", "date'2024-01-01' invoice_date",
                                       "cast(9.99 as decimal(18,2)) total_amount")
    txn = spark.range(20_000).selectExpr("'s' statement_id", "id row_idx", "date_add(date'2024-01-01', cast(id % 90 as int)) date",
                                         "concat('pay N', id) description", "cast(9.99 as decimal(18,2)) amount")
    got = M.match(inv, txn, 0.02, 90)
    assert "levenshtein(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.where("n_candidates = 20000 AND bank_description = concat('pay ', invoice_number)").count() == 1000
    joined = M._block_join(M._invoice_side(inv, ["filename"]), M._transaction_side(txn, []), F.lit(False), [], 0.02, 90, "inner", "date",
                           ["filename"], 0, 0)
    assert joined.count() <= 16 * 313 * 4


def _tables(spark, at):
    spark.range(40).selectExpr("id o_orderkey", "id % 7 o_custkey", "timestamp'2024-01-05 00:00:00' o_orderdate", "100.0D + id % 3 o_totalprice") \
        .coalesce(1).write.parquet(f"{at}/orders.parquet")
    spark.range(90).selectExpr("id % 40 l_orderkey", "cast(id % 5 as int) l_linenumber", "timestamp'2024-01-09 00:00:00' l_shipdate", "id l_partkey",
                               "101.0D + id % 11 l_extendedprice").coalesce(1).write.parquet(f"{at}/lineitem.parquet")


def test_ranked_query_shuffles_no_pairs(spark, tmp_path):
    _tables(spark, tmp_path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["rank_candidates"](spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    at = next(k for k, line in enumerate(plan) if "Window " in line)
    down = plan[at:next(k for k, line in enumerate(plan) if "SortMergeJoin" in line)]
    assert down and not [line for line in down if "Exchange" in line]  # the candidates were dealt out by invoice before
    assert len(rows) > 1000 and {r["rank"] for r in rows if r.filename == "ord_1.pdf"} == set(range(1, sum(r.filename == "ord_1.pdf" for r in rows) + 1))
