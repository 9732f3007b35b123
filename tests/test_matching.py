import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgermatch.operators.matching import (_invoice_side, _transaction_side, candidates, match, match_days,
                                            rank_candidates)

INV = "filename string, invoice_number string, invoice_date date, total_amount decimal(18,2)"
TXN = "statement_id string, row_idx long, date date, description string, amount decimal(18,2)"
D = dt.date


def run(spark, invs, txns, **kw):
    i = spark.createDataFrame(invs, INV)
    t = spark.createDataFrame(txns, TXN)
    return {r.filename: r for r in match(i, t, **kw).collect()}


def test_reference_case(spark):
    r = run(spark, [("invoice.pdf", "INV-123", D(2024, 5, 10), Decimal("100.00"))],
            [("s", 0, D(2024, 5, 12), "Paiement INV-123", Decimal("100.00")),
             ("s", 1, D(2024, 5, 12), "Autre paiement", Decimal("50.00"))],
            amount_tolerance=0.02, max_days=30)["invoice.pdf"]
    assert r.matched and r.match_score == pytest.approx(48.75) and r.bank_row_idx == 0


def test_edges(spark):
    invs = [("tol_in", "A1", D(2024, 1, 1), Decimal("1.00")),
            ("tol_out", "A2", D(2024, 1, 1), Decimal("2.00")),
            ("day0", "A3", D(2024, 3, 1), Decimal("30.00")),
            ("day90", "A4", D(2024, 3, 1), Decimal("40.00")),
            ("day91", "A5", D(2024, 3, 1), Decimal("50.00")),
            ("before", "A6", D(2024, 3, 1), Decimal("60.00")),
            ("nodate", "A7", None, Decimal("70.00")),
            ("nototal", "A8", D(2024, 1, 1), None),
            ("nonumber", None, D(2024, 1, 1), Decimal("80.00")),
            ("neg", "A9", D(2024, 1, 1), Decimal("90.00"))]
    txns = [("s", 1, D(2024, 1, 2), "x", Decimal("1.02")),
            ("s", 2, D(2024, 1, 2), "x", Decimal("2.03")),
            ("s", 3, D(2024, 3, 1), "x", Decimal("30.00")),
            ("s", 4, D(2024, 5, 30), "x", Decimal("40.00")),
            ("s", 5, D(2024, 5, 31), "x", Decimal("50.00")),
            ("s", 6, D(2024, 2, 29), "x", Decimal("60.00")),
            ("s", 7, D(1990, 1, 1), "x", Decimal("70.00")),
            ("s", 8, D(2024, 1, 2), "x", Decimal("80.00")),
            ("s", 9, D(2024, 1, 2), "x", Decimal("-90.00"))]
    r = run(spark, invs, txns, amount_tolerance=0.02, max_days=90)
    assert {k for k, v in r.items() if v.matched} == {"tol_in", "day0", "day90", "nodate", "nonumber", "neg"}
    assert r["nonumber"].match_score == 5.0 and r["neg"].bank_amount == Decimal("-90.00")
    assert r["tol_in"].match_score == pytest.approx(0.0)


def test_ties_and_shared_payment(spark):
    invs = [("a", "N1", D(2024, 1, 1), Decimal("10.00")), ("b", "N2", D(2024, 1, 1), Decimal("10.00"))]
    txns = [("s", 5, D(2024, 1, 9), "zz", Decimal("10.00")),
            ("s", 7, D(2024, 1, 3), "zz", Decimal("10.00")),
            ("s", 6, D(2024, 1, 3), "zz", Decimal("10.00"))]
    r = run(spark, invs, txns)
    assert r["a"].bank_row_idx == 6 and r["b"].bank_row_idx == 6 and r["a"].n_candidates == 3
    r2 = run(spark, invs, txns, tie_order="row")
    assert r2["a"].bank_row_idx == 5


def brute_force(invs, txns, tol_c, days):
    out = {}
    for f, num, idate, tot in invs:
        best = None
        for sid, ri, tdate, desc, amt in txns:
            if tot is None or abs(abs(int(amt * 100)) - abs(int(tot * 100))) > tol_c:
                continue
            if idate is not None and not (tdate >= idate and (tdate - idate).days <= days):
                continue
            key = (ri,)
            if best is None or key < best:
                best = key
        out[f] = None if best is None else best[0]
    return out


@pytest.mark.parametrize("tol,days", [(0, 0), (0.02, 90), (0.05, 3), (1.00, 30)])
def test_bucketed_join_equals_brute_force(spark, tol, days):
    rnd = random.Random(int(tol * 100) + days)
    invs, txns = [], []
    for i in range(150):
        c = rnd.randint(0, 400)
        invs.append((f"i{i}", "", None if i % 9 == 0 else D(2024, 1, 1) + dt.timedelta(rnd.randint(0, 200)),
                     None if i % 13 == 0 else Decimal(c) / 100))
    for j in range(300):
        c = rnd.randint(-400, 400)
        txns.append(("s", j, D(2024, 1, 1) + dt.timedelta(rnd.randint(0, 260)), "d", Decimal(c) / 100))
    # all scores are 0 or 5 (blank numbers): compare candidate sets instead of winners
    i = spark.createDataFrame(invs, INV)
    t = spark.createDataFrame(txns, TXN)
    got = {(r.filename, r.bank_row_idx) for r in candidates(i, t, tol, days).collect()}
    tol_c = int(round(tol * 100))
    want = set()
    for f, num, idate, tot in invs:
        for sid, ri, tdate, desc, amt in txns:
            if tot is None or abs(abs(amt) - abs(tot)) * 100 > tol_c:
                continue
            if idate is not None and not (tdate >= idate and (tdate - idate).days <= days):
                continue
            want.add((f, ri))
    assert got == want
    salted = {(r.filename, r.bank_row_idx) for r in
              candidates(i, t, tol, days, hot_key_salts=4, hot_key_rows=3).collect()}
    assert salted == want


def test_salted_match_equals_plain(spark):
    invs = [(f"i{k}", f"N{k}", D(2024, 1, 1), Decimal("99.99")) for k in range(20)]
    txns = [("s", j, D(2024, 1, 1) + dt.timedelta(j % 50), f"PAY N{j % 25}", Decimal("99.99")) for j in range(400)]
    plain = run(spark, invs, txns)
    salted = run(spark, invs, txns, hot_key_salts=8, hot_key_rows=10)
    assert {k: (v.bank_row_idx, v.n_candidates) for k, v in plain.items()} == \
        {k: (v.bank_row_idx, v.n_candidates) for k, v in salted.items()}


def test_rank_form_agrees(spark):
    invs = [(f"i{k}", f"N{k}", D(2024, 1, 1), Decimal("99.99")) for k in range(10)]
    txns = [("s", j, D(2024, 1, 1) + dt.timedelta(j % 50), f"PAY N{j % 12}", Decimal("99.99")) for j in range(100)]
    i, t = spark.createDataFrame(invs, INV), spark.createDataFrame(txns, TXN)
    best = {r.filename: r.bank_row_idx for r in match(i, t).collect()}
    ranked = {r.filename: r.bank_row_idx for r in rank_candidates(candidates(i, t)).where("rank = 1").collect()}
    assert best == ranked


def test_plan_has_no_nested_loop(spark):
    i = spark.createDataFrame([("a", "N", D(2024, 1, 1), Decimal("1.00"))], INV)
    t = spark.createDataFrame([("s", 1, D(2024, 1, 2), "N", Decimal("1.00"))], TXN)
    plan = match(i, t)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "HashJoin" in plan or "SortMergeJoin" in plan


def test_partial_ratio_scorer(spark):
    r = run(spark, [("a", "INV-1", D(2024, 1, 1), Decimal("5.00"))],
            [("s", 1, D(2024, 1, 2), "VIREMENT FACTURE INV-1 MERCI", Decimal("5.00")),
             ("s", 2, D(2024, 1, 2), "INV-7", Decimal("5.00"))], scorer="partial_ratio")
    assert r["a"].bank_row_idx == 1 and r["a"].match_score == 105.0


def test_rank_hot_invoice_spans_partitions(spark):
    # one invoice with 600 candidates (a hot key) and a few ordinary ones
    invs = [("hot", "N0", None, Decimal("50.00"))] + [(f"i{k}", f"N{k}", D(2024, 1, 1), Decimal(k)) for k in range(1, 6)]
    txns = [("s", j, D(2023, 1, 1) + dt.timedelta(j % 300), f"PAY N{j % 17}", Decimal("50.00")) for j in range(600)]
    txns += [("s", 1000 + k, D(2024, 1, 2), f"N{k}", Decimal(k)) for k in range(1, 6)]
    i, t = spark.createDataFrame(invs, INV), spark.createDataFrame(txns, TXN)
    c = candidates(i, t)
    ranked = rank_candidates(c)
    hot = ranked.where("filename = 'hot'").select("rank", "match_score", "bank_date", "bank_row_idx").collect()
    assert sorted(r["rank"] for r in hot) == list(range(1, 601))
    by_rank = sorted(hot, key=lambda r: r["rank"])
    keys = [(-r.match_score, r.bank_date, r.bank_row_idx) for r in by_rank]
    assert keys == sorted(keys)
    best = {r.filename: r.bank_row_idx for r in match(i, t).collect()}
    assert best["hot"] == by_rank[0].bank_row_idx


def test_rank_equals_row_number_with_all_columns(spark):
    from pyspark.sql import Window
    c = spark.range(60_000).selectExpr(
        "concat('i', id % 7) as filename", "cast(id % 13 as double) / 3 as match_score",
        "date_add(date'2024-01-01', cast(id * 7 % 400 as int)) as bank_date", "id % 100 as bank_cents",
        "concat('d', id % 11) as bank_description", "concat('s', id % 3) as bank_statement_id",
        "id as bank_row_idx", "concat('extra', id) as more")
    for tie, first in (("date", "bank_date"), ("row", "bank_statement_id")):
        order = [F.col("match_score").desc(), first] + (["bank_row_idx", "bank_statement_id"] if tie == "date"
                                                        else ["bank_row_idx", "bank_date"])
        want = c.withColumn("want", F.row_number().over(Window.partitionBy("filename").orderBy(*order)))
        got = rank_candidates(c, tie_order=tie)
        assert got.count() == 60_000 and got.columns == c.columns + ["rank"]
        assert got.join(want, c.columns).where("rank <> want").count() == 0


def test_invoices_of_one_name_stay_apart(spark):
    rows = spark.createDataFrame([("x.pdf", "N1", D(2024, 1, 1), Decimal("5.00")), ("x.pdf", "N9", D(2024, 1, 1), Decimal("2.00")),
                                  ("y.pdf", "N2", None, Decimal("2.00")), ("y.pdf", "N2", None, Decimal("2.00"))], INV)
    txn = spark.createDataFrame([("s", 1, D(2024, 1, 2), "N9", Decimal("2.00")), ("s", 2, D(2024, 1, 2), "N9", Decimal("2.00")),
                                 ("s", 3, D(9999, 12, 31), "far", Decimal("2.00"))], TXN)
    got = sorted((r.filename, r.invoice_number, r.bank_row_idx, r.n_candidates) for r in match(rows, txn).collect())
    assert got == [("x.pdf", "N1", None, 0), ("x.pdf", "N9", 1, 2), ("y.pdf", "N2", 1, 3), ("y.pdf", "N2", 1, 3)]


def test_undated_invoices_do_not_multiply(spark):
    inv = spark.range(2000).selectExpr("concat('f', id) as filename", "'N' as invoice_number", "cast(null as date) as invoice_date",
                                       "cast(id as decimal(18,2)) as total_amount")
    txn = spark.createDataFrame([("s", 1, D(1900, 1, 1), "x", Decimal("7.00")), ("s", 2, D(9999, 12, 31), "x", Decimal("8.00"))], TXN)
    assert match(inv, txn).where("matched").count() == 2
    plan = candidates(inv, txn)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("order", ["date", "row"])
@pytest.mark.parametrize("tol,days", [(0, 0), (0.02, 10), (0.5, 400)])
def test_numberless_invoices_equal_brute_force(spark, tol, days, order):
    rnd = random.Random(days)
    start, tol_c = D(2024, 1, 1), int(round(tol * 100))
    invs = [(f"i{k % 110}", rnd.choice([None, "", "  "]), None if k % 9 == 0 else start + dt.timedelta(rnd.randint(0, 60)),
             None if k % 13 == 0 else Decimal(rnd.randint(-60, 60)) / 100) for k in range(120)]
    txns = [(rnd.choice(["s", "t", None]), rnd.randint(0, 40), start + dt.timedelta(rnd.randint(0, 80)),
             rnd.choice(["a", "b", None]), Decimal(rnd.randint(-60, 60)) / 100) for _ in range(400)]
    none_first = lambda *key: tuple((v is not None, v) for v in key)
    want = []
    for name, number, day, total in invs:
        fits = []
        for sid, row, when, text, amount in txns:
            off = None if total is None else abs(abs(amount) - abs(total)) * 100
            if off is not None and off <= tol_c and (day is None or 0 <= (when - day).days <= days):
                score = 0.0 if off else 5.0
                place = (when, row, sid) if order == "date" else (sid, row, when)
                fits.append((none_first(-score, *place, amount, text), (score, when, amount, text, sid, row)))
        want.append((name, total, day, min(fits)[1] if fits else None, len(fits)))
    got = match(spark.createDataFrame(invs, INV), spark.createDataFrame(txns, TXN), tol, days, tie_order=order).collect()
    have = [(r.filename, r.total_amount, r.invoice_date,
             (r.match_score, r.bank_date, r.bank_amount, r.bank_description, r.bank_statement_id, r.bank_row_idx)
             if r.matched else None, r.n_candidates) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_numberless_invoices_of_one_amount_make_no_pairs(spark):
    """300 blank invoices x 200,000 payments of one amount: the join yields days, not payments."""
    inv = spark.range(300).selectExpr("concat('i', id) filename", "'' invoice_number",
                                      "date_add(date'2024-01-01', cast(id % 30 as int)) invoice_date",
                                      "cast(9.99 as decimal(18,2)) total_amount")
    txn = spark.range(200_000).selectExpr("'s' statement_id", "id row_idx", "date_add(date'2024-01-01', cast(id % 365 as int)) date",
                                          "concat('pay ', id) description", "cast(9.99 as decimal(18,2)) amount")
    joined = match_days(_invoice_side(inv, ["filename"]), _transaction_side(txn, []), [], 0.02, 90)
    assert joined.count() == 30 * 91
    got = match(inv, txn, 0.02, 90)
    per_day = {r["date"]: (r["n"], r["first"]) for r in txn.groupBy("date").agg(F.count("*").alias("n"), F.min("row_idx").alias("first")).collect()}
    for r in got.collect():
        days = [r.invoice_date + dt.timedelta(k) for k in range(91)]
        assert r.n_candidates == sum(per_day[d][0] for d in days)
        assert (r.bank_date, r.bank_row_idx, r.match_score) == (r.invoice_date, per_day[r.invoice_date][1], 5.0)


def test_keyed_numberless_invoices(spark):
    inv = spark.createDataFrame([("a", None, D(2024, 1, 1), Decimal("5.00"), "x"), ("b", "", None, Decimal("5.00"), "y"),
                                 ("c", "", D(2024, 1, 1), Decimal("5.00"), None)], INV + ", customer string")
    txn = spark.createDataFrame([("s", 1, D(2024, 1, 3), "p", Decimal("5.00"), "x"), ("s", 2, D(2024, 1, 2), "p", Decimal("-5.01"), "x"),
                                 ("s", 3, D(2023, 1, 2), "p", Decimal("-5.00"), "y"), ("s", 4, D(2024, 1, 2), "p", Decimal("5.00"), None)],
                                TXN + ", customer string")
    r = {r.filename: r for r in match(inv, txn, 0.02, 90, keys=["customer"]).collect()}
    assert (r["a"].bank_row_idx, r["a"].n_candidates) == (1, 2)
    assert (r["b"].bank_row_idx, r["b"].bank_amount, r["b"].n_candidates) == (3, Decimal("-5.00"), 1)
    assert not r["c"].matched and r["c"].n_candidates == 0


def test_ranked_candidates_move_once(spark):
    """The window's exchange of the candidates also serves the join with the offsets; nulls and
    zero scores are values of the key."""
    c = spark.range(2000).selectExpr(
        "CASE WHEN id % 7 > 0 THEN concat('i', id % 7) END filename", "cast(id % 5 as double) match_score",
        "CASE WHEN id % 11 > 0 THEN date_add(date'2024-01-01', cast(id * 7 % 400 as int)) END bank_date", "id % 100 bank_cents",
        "concat('d', id % 11) bank_description", "'s' bank_statement_id", "id bank_row_idx")
    ranked = rank_candidates(c)
    from pyspark.sql import Window
    want = c.withColumn("want", F.row_number().over(Window.partitionBy("filename").orderBy(F.col("match_score").desc(), "bank_date", "bank_row_idx")))
    assert ranked.join(want, "bank_row_idx").where("rank = want").count() == 2000
    run = ranked._jdf.queryExecution()
    run.toRdd().count()
    plan = run.executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    moved = [line for line, below in zip(plan, plan[1:]) if "+- Exchange hashpartitioning" in line and "bank_description" in below]
    assert len(moved) == 1, moved
    assert sum("Range (" in line for line in plan) == 1  # made once: the other branch reads the same exchange
