"""Invoice <-> bank transaction matching.

Semantics: a transaction is a *candidate* for an invoice when
``| |t.amount| - |i.total| | <= tolerance`` (inclusive; an invoice without a
total has no candidates) and, when the invoice has a date,
``i.date <= t.date <= i.date + max_days``. The score is a text similarity of
the invoice number against the description (0 for a blank number) plus 5
when the absolute amounts are equal. Each invoice keeps its best candidate:
highest score, then earliest date, then lowest row index. Invoices keep one
output row each, matched or not; one transaction may be the best candidate
of several invoices.

Plan shape: amounts are integral cents, and amounts and days are cut into
cells, some times wider than the tolerance band and the day window. An
invoice lies in one cell; a transaction is copied to each cell from which an
invoice can reach it (1.4 on average), so all candidates of an invoice meet
in its cell. The rows of a cell are packed into blocks of 64 in the order of
amounts; blocks of one cell are joined where their amounts can meet, and
the exact tests and scores of two blocks' pairs are made in Arrow batches
(``functions.pair_scores``). ``match`` gets one row per invoice and block
back and reduces those by ``min_by``, so its pairs are never rows, let alone
sorted or shuffled. ``candidates`` unpacks every pair where it was made, and
``rank_candidates`` ranks them there. Invoices without a date lie in a cell
of their amount for all days; transactions are copied to those cells only if
such invoices exist.

``match`` reduces both inputs first: equal invoice rows to one row with its
number of copies, equal transactions (date, amount, description) to their
first row with a count, which takes the repeats out of hot cells. The invoice
blocks are joined from the left, so unmatched invoices need no second join.

Invoices without a number score by amount alone, so they need no pairs with
single transactions: these are reduced to one row per day and absolute
amount (its first transaction and their count), and the invoices to distinct
(keys, date, amount). A day's row meets at most (2*tol+1)*(max_days+1) of
those, whatever the number of payments or invoices of one amount.

Skew: a cell is worked on by one task, block by block. ``hot_key_salts > 0``
salts cells holding at least ``hot_key_rows`` transactions: their
transactions are dealt over that many salts and only their invoices are
replicated.
"""

from __future__ import annotations

from decimal import ROUND_FLOOR, Decimal
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.amounts import amount_to_cents, cents_to_amount
from ..functions.pair_scores import UNDATED, pair_scores
from ..functions.similarity import levenshtein_score, partial_ratio

EXACT_BONUS = 5.0  # fixed value: bonus for equal absolute amounts
BLOCK = 64  # rows of a block
WIDE, LONG = 8, 4  # tolerance bands and day windows a cell is wide


def tolerance_cents(amount_tolerance) -> int:
    """Tolerance in whole cents (amounts carry two decimals)."""
    tol = abs(Decimal(str(amount_tolerance)))
    return int((tol * 100).to_integral_value(rounding=ROUND_FLOOR))


def amount_within(a_cents: Column, b_cents: Column, tol_cents: int) -> Column:
    """``| |a| - |b| | <= tol``; NULL inputs never match."""
    return F.coalesce(F.abs(F.abs(a_cents) - F.abs(b_cents)) <= F.lit(tol_cents), F.lit(False))


def date_within(inv_date: Column, txn_date: Column, max_days: int) -> Column:
    """NULL invoice date passes; else ``0 <= t - i <= max_days``."""
    return inv_date.isNull() | (
        (txn_date >= inv_date) & (F.datediff(txn_date, inv_date) <= F.lit(int(max_days))))


def _epoch_day(c: Column) -> Column:
    return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")


def _floor_div(x: Column, w: int) -> Column:
    return F.floor(x.cast("double") / F.lit(float(w))).cast("long")


def _score(scorer: str, number: Column, description: Column) -> Column:
    if scorer == "levenshtein":
        return levenshtein_score(number, description)
    if scorer == "partial_ratio":
        return partial_ratio(number, description)
    raise ValueError(f"unknown scorer {scorer!r}")


def _invoice_side(invoices: DataFrame, kept: Sequence[str]) -> DataFrame:
    """``kept`` columns plus what the join compares."""
    return invoices.select(*kept, F.col("invoice_number").alias("_inv_number"),
                           F.col("invoice_date").alias("_inv_date"),
                           amount_to_cents("total_amount").alias("_inv_cents")) \
        .withColumn("_inv_acents", F.abs("_inv_cents")).withColumn("_inv_day", _epoch_day(F.col("_inv_date")))


def _transaction_side(transactions: DataFrame, keys: Sequence[str]) -> DataFrame:
    stmt = (F.col("statement_id") if "statement_id" in transactions.columns
            else F.lit(None).cast("string"))
    return transactions.where(F.col("amount").isNotNull() & F.col("date").isNotNull()).select(
        *[F.col(k).alias(f"_t_{k}") for k in keys], F.col("date").alias("bank_date"),
        amount_to_cents("amount").alias("bank_cents"), F.col("description").alias("bank_description"),
        stmt.alias("bank_statement_id"), F.col("row_idx").cast("long").alias("bank_row_idx"))


def _band_join(inv: DataFrame, txn: DataFrame, keys: Sequence[str], amount_tolerance, max_days: int, how: str,
               hot_key_salts: int, hot_key_rows: int) -> DataFrame:
    """``inv`` (``_invoice_side``) joined to ``txn`` (``_transaction_side``)
    on the bands; with ``how="left"`` an invoice keeps at least one row."""
    if max_days < 0:
        raise ValueError("max_days must be >= 0")
    tol = tolerance_cents(amount_tolerance)
    aw = 2 * tol + 1          # amount bucket width (cents)
    dw = int(max_days) + 1    # date bucket width (days)
    txn = txn.withColumn("_ab", F.floor(F.abs("bank_cents") / F.lit(aw)).cast("long")) \
        .withColumn("_db", _floor_div(_epoch_day(F.col("bank_date")), dw))
    lo_ab = F.floor(F.greatest(F.col("_inv_acents") - tol, F.lit(0)) / F.lit(aw)).cast("long")
    hi_ab = F.floor((F.col("_inv_acents") + tol) / F.lit(aw)).cast("long")
    inv = inv.withColumn("_ab", F.explode_outer(F.sequence(lo_ab, hi_ab)))
    if how != "left":
        inv = inv.where(F.col("_ab").isNotNull())
    out = None
    for dated in (True, False):
        i, t, join_keys = inv.where(F.col("_inv_date").isNotNull() == F.lit(dated)), txn, ["_ab"]
        if dated:
            i = i.withColumn("_db", F.explode(F.sequence(
                _floor_div(F.col("_inv_day"), dw), _floor_div(F.col("_inv_day") + F.lit(int(max_days)), dw))))
            join_keys = ["_ab", "_db"]
        if hot_key_salts and hot_key_salts > 1:
            i, t = _salt_hot_buckets(i, t, keys, join_keys, hot_key_salts, hot_key_rows)
            join_keys = join_keys + ["_salt"]
        cond = [i[k] == t[k] for k in join_keys] + [i[k] == t[f"_t_{k}"] for k in keys]
        cond.append(F.abs(t["bank_cents"]).between(i["_inv_acents"] - tol, i["_inv_acents"] + tol))
        cond.append(date_within(i["_inv_date"], t["bank_date"], max_days))
        kept = [c for c in inv.columns if c != "_ab"]
        bank = [c for c in t.columns if c.startswith("bank_")]
        pairs = i.join(t, on=cond, how=how).select(*[i[c] for c in kept], *bank)
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _blocks(rows: DataFrame, cell: Sequence[str], cents: str, name: str, of: Column) -> DataFrame:
    """The rows of each cell as arrays ``name`` of ``of``, in blocks of near
    amounts, with the least (``_lo``) and the greatest (``_hi``)."""
    at = F.row_number().over(Window.partitionBy(*cell).orderBy(cents))
    return rows.withColumn("_block", F.floor((at - 1) / F.lit(BLOCK))).groupBy(*cell, "_block").agg(
        F.collect_list(of).alias(name), F.min(cents).alias(f"{name}_lo"), F.max(cents).alias(f"{name}_hi"))


def _any(rows: DataFrame, condition: Column) -> Column:
    """Whether ``condition`` holds for any row, as a scalar subquery."""
    return F.coalesce(rows.agg(F.max(condition)).scalar(), F.lit(False))


def _block_join(inv: DataFrame, txn: DataFrame, undated: Column, keys: Sequence[str], amount_tolerance, max_days: int, how: str,
                tie_order: str, kept: Sequence[str], hot_key_salts: int, hot_key_rows: int, best: bool = False) -> DataFrame:
    """``inv`` (``_invoice_side`` with totals) and ``txn`` (``_transaction_side``)
    as pairs of blocks ``_inv`` and ``_txn`` beside their cell. ``undated``
    says whether any invoice has no date. With ``best``, equal transactions
    are one row with its ``bank_copies``."""
    if max_days < 0:
        raise ValueError("max_days must be >= 0")
    tol = tolerance_cents(amount_tolerance)
    aw, dw, days = WIDE * (2 * tol + 1), LONG * (int(max_days) + 1), int(max_days)
    all_days = F.lit(UNDATED).cast("long")
    i = inv.withColumn("_ab", F.floor(F.col("_inv_acents") / F.lit(aw)).cast("long")) \
        .withColumn("_db", F.coalesce(_floor_div(F.col("_inv_day"), dw), all_days))
    acents, day = F.abs("bank_cents"), _epoch_day(F.col("bank_date"))
    reached = F.sequence(_floor_div(day - F.lit(days), dw), _floor_div(day, dw))
    t = txn.withColumn("_ab", F.explode(F.sequence(F.floor(F.greatest(acents - tol, F.lit(0)) / F.lit(aw)).cast("long"),
                                                   F.floor((acents + tol) / F.lit(aw)).cast("long")))) \
        .withColumn("_db", F.explode(F.when(undated, F.concat(reached, F.array(all_days))).otherwise(reached)))
    own = [f"_t_{k}" for k in keys]
    bank = [*_ORDER[tie_order]]
    cell = ["_ab", "_db"]
    if hot_key_salts and hot_key_salts > 1:
        i, t = _salt_hot_buckets(i, t, keys, cell, hot_key_salts, hot_key_rows)
        cell = cell + ["_salt"]
    i_cell, t_cell = [*keys, *cell], [*own, *cell]
    if best:
        # dealt out by cell first: equal transactions meet there, and so do the blocks
        same = ["bank_date", "bank_cents", "bank_description"]
        place = [c for c in bank if c not in same]
        t = t.repartition(*[F.col(c) for c in t_cell]).groupBy(*t_cell, *same).agg(
            F.min(F.struct(*place)).alias("_p"), F.count(F.lit(1)).alias("bank_copies")) \
            .select(*t_cell, *same, *[F.col("_p")[c].alias(c) for c in place], "bank_copies")
        bank.append("bank_copies")
    t = t.withColumn("_cents", F.abs("bank_cents"))
    low = F.lower(F.coalesce("bank_description", F.lit("")))
    tb = _blocks(t, t_cell, "_cents", "_txn", F.struct(*bank, "_cents", _epoch_day(F.col("bank_date")).alias("_day"), low.alias("_low"))) \
        .withColumn("_txn", F.sort_array("_txn"))  # by their order: the first of equal scores is the best
    number = F.when(~_numberless(), F.lower("_inv_number"))
    ib = _blocks(i, i_cell, "_inv_acents", "_inv", F.struct(
        *kept, "_inv_cents", "_inv_acents", F.coalesce("_inv_day", all_days).alias("_day"), number.alias("_low")))
    on = [ib[a] == tb[b] for a, b in zip(i_cell, t_cell)]
    on += [tb["_txn_lo"] <= ib["_inv_hi"] + tol, tb["_txn_hi"] >= ib["_inv_lo"] - tol]
    return ib.join(tb, on, how).select(*[ib[c] for c in cell], "_inv", "_txn")


def _scores(scorer: str, amount_tolerance, max_days: int, best: bool) -> Column:
    asked = [F.col("_inv")[c] for c in ("_day", "_inv_acents", "_low")] + [F.col("_txn")[c] for c in ("_day", "_cents", "_low")]
    if best:
        asked.append(F.col("_txn")["bank_copies"])
    return pair_scores(asked, scorer, tolerance_cents(amount_tolerance), int(max_days), EXACT_BONUS, best)


def candidates(invoices: DataFrame, transactions: DataFrame, amount_tolerance=0.02,
               max_days: int = 90, keys: Sequence[str] = (), scorer: str = "levenshtein",
               invoice_key: Sequence[str] = ("filename",), hot_key_salts: int = 0,
               hot_key_rows: int = 1_000_000, placed: bool = False) -> DataFrame:
    """All (invoice, transaction) pairs that pass the amount and date tests,
    with their score (J1 + J2 + F15/F16 + F17).

    Output: invoice key columns, ``keys``, ``_inv_cents``, ``bank_date``,
    ``bank_cents``, ``bank_description``, ``bank_statement_id``,
    ``bank_row_idx``, ``match_score``; with ``placed`` also ``PLACED``, by
    which ``rank_candidates`` knows where the candidates of an invoice lie.
    """
    kept, keys = list(dict.fromkeys([*invoice_key, *keys])), list(keys)
    inv = _invoice_side(invoices.where(F.col("total_amount").isNotNull()), kept)
    txn = _transaction_side(transactions, keys)

    undated = _any(inv, F.col("_inv_date").isNull())
    bank = ["bank_date", "bank_cents", "bank_description", "bank_statement_id", "bank_row_idx"]

    def blocks(inv, txn, kept):
        return _block_join(inv, txn, undated, keys, amount_tolerance, max_days, "inner", "date", kept, hot_key_salts, hot_key_rows)

    def pairs_here(inv, txn):
        """Tested and scored by columns alone: no Python between, so that Spark knows the rows stay in their cells."""
        made = blocks(inv, txn, [*kept, "_inv_number", "_inv_date"]).select("_ab", "_db", F.inline("_inv"), "_txn").drop("_low", "_day")
        made = made.select(*[c for c in made.columns if c != "_txn"], F.inline("_txn")).where(
            amount_within(F.col("_inv_cents"), F.col("bank_cents"), tolerance_cents(amount_tolerance))
            & date_within(F.col("_inv_date"), F.col("bank_date"), max_days))
        exact = F.when(F.col("_cents") == F.col("_inv_acents"), F.lit(EXACT_BONUS)).otherwise(F.lit(0.0))
        return made.select("_ab", "_db", *kept, "_inv_cents", *bank,
                           (_score(scorer, F.col("_inv_number"), F.col("bank_description")) + exact).alias("match_score"))

    if not placed or (hot_key_salts and hot_key_salts > 1):
        found = blocks(inv, txn, kept).withColumn("_scores", _scores(scorer, amount_tolerance, max_days, False)) \
            .select("_inv", "_txn", F.inline("_scores"))
        i, t = F.col("_inv")[F.col("i")], F.col("_txn")[F.col("t")]
        return found.select(*[i[c].alias(c) for c in [*kept, "_inv_cents"]], *[t[c].alias(c) for c in bank],
                            F.col("score").alias("match_score"))
    # an invoice key whose rows differ in amount or date can lie in several cells
    tol, same = tolerance_cents(amount_tolerance), Window.partitionBy(*invoice_key)
    aw, dw = WIDE * (2 * tol + 1), LONG * (int(max_days) + 1)
    spots = {"_a": F.floor(F.col("_inv_acents") / F.lit(aw)), "_d": F.coalesce(_floor_div(F.col("_inv_day"), dw), F.lit(UNDATED))}
    seen = inv.select("*", *[c.cast("long").alias(n) for n, c in spots.items()]).withColumn(
        "_whole", (F.min("_a").over(same) == F.max("_a").over(same)) & (F.min("_d").over(same) == F.max("_d").over(same)))
    apart = _any(seen, ~F.col("_whole"))
    parts = [pairs_here(seen.where(F.col("_whole") == F.lit(whole)).drop("_a", "_d", "_whole"), txn if whole else txn.where(apart))
             .withColumn("_whole", F.lit(whole)) for whole in (True, False)]
    return parts[0].unionByName(parts[1])


def _salt_hot_buckets(inv: DataFrame, txn: DataFrame, keys, bucket: Sequence[str], salts: int, hot_rows: int):
    """Deal the transactions of hot buckets over ``salts`` salts and copy
    only the invoices of those buckets. The hot-bucket table has at most
    |transactions| / hot_rows rows; it is joined without a hint so AQE
    broadcasts it only when its measured size is small."""
    bkeys = [f"_t_{k}" for k in keys] + list(bucket)
    hot = (txn.groupBy(*bkeys).count().where(F.col("count") >= hot_rows)
              .select(*bkeys, F.lit(True).alias("_hot")))
    txn = (txn.join(hot, on=bkeys, how="left")
              .withColumn("_salt", F.when(F.col("_hot"), F.pmod(
                  F.xxhash64("bank_statement_id", "bank_row_idx"), F.lit(salts))).otherwise(F.lit(0)))
              .drop("_hot"))
    hot_i = hot.select(*[F.col(f"_t_{k}").alias(k) for k in keys], *bucket, "_hot")
    inv = (inv.join(hot_i, on=list(keys) + list(bucket), how="left")
              .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"),
                                                                             F.lit(salts - 1).cast("long")))
                                             .otherwise(F.array(F.lit(0).cast("long")))))
              .drop("_hot"))
    txn = txn.withColumn("_salt", F.col("_salt").cast("long"))
    return inv, txn


#: What orders candidates of one score.
_ORDER = {"date": ["bank_date", "bank_row_idx", "bank_statement_id", "bank_cents", "bank_description"],
          "row": ["bank_statement_id", "bank_row_idx", "bank_date", "bank_cents", "bank_description"]}
PLACED = ["_ab", "_db", "_whole"]
BEST = ["match_score", "bank_date", "bank_cents", "bank_description", "bank_statement_id", "bank_row_idx"]


def _order_key(tie_order: str) -> Column:
    if tie_order not in _ORDER:
        raise ValueError(f"unknown tie_order {tie_order!r}")
    return F.struct(-F.col("match_score"), *_ORDER[tie_order])


def match(invoices: DataFrame, transactions: DataFrame, amount_tolerance=0.02,
          max_days: int = 90, keys: Sequence[str] = (), scorer: str = "levenshtein",
          tie_order: str = "date", invoice_key: Sequence[str] | None = None,
          hot_key_salts: int = 0, hot_key_rows: int = 1_000_000) -> DataFrame:
    """One row per invoice with its best transaction, if any.

    ``invoices``: filename, invoice_number, invoice_date (date), total_amount
    (decimal), optionally section_no and the ``keys`` columns.
    ``transactions``: date, description, amount (decimal), row_idx,
    optionally statement_id and the ``keys`` columns.
    ``invoice_key`` names the columns that label an invoice (default:
    filename [, section_no]); invoices that share them but differ in number,
    date or total stay apart, and equal rows stay as many as they are.

    Output: invoice key, invoice_number, invoice_date, total_amount, matched,
    match_score, bank_date, bank_amount, bank_description,
    bank_statement_id, bank_row_idx, n_candidates (A7).
    """
    if invoice_key is None:
        invoice_key = ["filename"] + (["section_no"] if "section_no" in invoices.columns else [])
    ikey, keys = list(invoice_key), list(keys)
    carried = [c for c in ("invoice_number", "invoice_date", "total_amount") if c not in ikey]
    label = list(dict.fromkeys([*ikey, *keys, *carried]))

    inv = invoices.groupBy(*label).agg(F.count(F.lit(1)).alias("_copies"))
    _order_key(tie_order)
    txn = _transaction_side(transactions, keys)
    side = _invoice_side(inv, label + ["_copies"])
    amounts = F.col("_inv_acents").isNotNull()
    undated = _any(side, F.when(F.col("_inv_date").isNull(), F.col("_copies") > 0))
    joined = _block_join(side.where(~_numberless() & amounts), txn, undated, keys, amount_tolerance, max_days, "left", tie_order,
                         label + ["_copies"], hot_key_salts, hot_key_rows, True) \
        .withColumn("_scores", _scores(scorer, amount_tolerance, max_days, True))
    pairs = joined.select("_inv", "_txn", F.posexplode("_scores").alias("_pos", "_s"))
    i, t = F.col("_inv")[F.col("_pos")], F.col("_txn")[F.col("_s.t")]
    pairs = pairs.select(*[i[c].alias(c) for c in [*label, "_copies"]], F.col("_s.score").alias("match_score"),
                         *[t[c].alias(c) for c in _ORDER[tie_order]], F.col("_s.n").alias("_n"))
    found = F.col("bank_date").isNotNull()
    rows = [*label, "_copies", "_best", "n_candidates"]
    best = pairs.groupBy(*label, "_copies").agg(
        F.min_by(F.when(found, F.struct(*BEST)), F.when(found, _order_key(tie_order))).alias("_best"),
        F.sum("_n").alias("n_candidates")).select(*rows)
    blank = _any(side, F.when(_numberless(), F.col("_copies") > 0))
    best = best.unionByName(_match_numberless(side.where(_numberless()), txn.where(blank), keys, amount_tolerance, max_days,
                                              tie_order).select(*rows))
    none = pairs.select(F.struct(*BEST).alias("_best")).schema["_best"].dataType
    best = best.unionByName(side.where(~_numberless() & ~amounts).select(
        *label, "_copies", F.lit(None).cast(none).alias("_best"), F.lit(0).cast("long").alias("n_candidates")))
    return best.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(
        *ikey, *carried,
        F.col("_best").isNotNull().alias("matched"),
        F.col("_best.match_score").alias("match_score"),
        F.col("_best.bank_date").alias("bank_date"),
        cents_to_amount(F.col("_best.bank_cents")).alias("bank_amount"),
        F.col("_best.bank_description").alias("bank_description"),
        F.col("_best.bank_statement_id").alias("bank_statement_id"),
        F.col("_best.bank_row_idx").alias("bank_row_idx"),
        F.col("n_candidates"))


def _numberless() -> Column:
    return F.coalesce(F.trim("_inv_number"), F.lit("")) == ""


def match_days(side: DataFrame, txn: DataFrame, keys: Sequence[str], amount_tolerance, max_days: int,
               tie_order: str = "date") -> DataFrame:
    """Distinct (keys, date, absolute amount) of ``side`` (``_invoice_side``)
    joined to the days of ``txn`` (``_transaction_side``) that pass the
    amount and date tests: ``bank_first``, a day's first transaction of one
    absolute amount, and ``bank_copies``, how many there are."""
    asked = side.where(F.col("_inv_acents").isNotNull()).select(*keys, "_inv_date", "_inv_acents", "_inv_day").distinct()
    first = [c for c in _ORDER[tie_order] if c != "bank_date"]
    days = txn.groupBy(*[f"_t_{k}" for k in keys], "bank_date", F.abs("bank_cents").alias("_acents")).agg(
        F.min(F.struct(*first)).alias("bank_first"), F.count(F.lit(1)).alias("bank_copies")) \
        .withColumnRenamed("_acents", "bank_cents")
    return _band_join(asked, days, keys, amount_tolerance, max_days, "inner", 0, 0)


def _match_numberless(side: DataFrame, txn: DataFrame, keys: Sequence[str], amount_tolerance, max_days: int,
                      tie_order: str) -> DataFrame:
    """``side`` with ``_best`` and ``n_candidates`` by amount and date alone."""
    asked = [*keys, "_inv_date", "_inv_acents"]
    score = F.when(F.col("bank_cents") == F.col("_inv_acents"), F.lit(EXACT_BONUS)).otherwise(F.lit(0.0))
    rows = match_days(side, txn, keys, amount_tolerance, max_days, tie_order) \
        .select(*asked, score.alias("match_score"), "bank_date", "bank_first.*", "bank_copies")  # bank_first's signed bank_cents
    answers = rows.groupBy(*asked).agg(F.min_by(F.struct(*BEST), _order_key(tie_order)).alias("_best"),
                                       F.sum("bank_copies").alias("n_candidates"))
    answers = answers.select(*[F.col(c).alias(f"_q_{c}") for c in asked], "_best", "n_candidates")
    on = [side[c].eqNullSafe(answers[f"_q_{c}"]) for c in asked]
    return side.join(answers, on=on, how="left") \
        .withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))


def rank_candidates(cands: DataFrame, invoice_key: Sequence[str] = ("filename",),
                    tie_order: str = "date") -> DataFrame:
    """Every candidate with its rank (1 = best) inside its invoice; the
    ranking form of ``match``'s arg-max.

    Candidates that ``candidates`` has ``placed`` are ranked in their cells,
    where all of an invoice lie together: they are sorted task by task and not
    shuffled. Those of invoice keys that lie in several cells, and all others,
    are ranked as follows.

    No window over whole invoices: an invoice's candidates are cut by the
    leading parts of the order itself (the score, then the month or the
    statement). The small counts of those parts give each one its offset, and
    ``row_number`` runs inside a part. Everything derives from the rows'
    values, so both branches agree however they are partitioned.
    """
    if set(PLACED) <= set(cands.columns):
        rest = [c for c in cands.columns if c not in PLACED]
        here = Window.partitionBy(*PLACED[:2], *invoice_key).orderBy(*_order_cols(tie_order))
        whole = cands.where("_whole").select(*rest, F.row_number().over(here).cast("long").alias("rank"))
        return whole.unionByName(rank_candidates(cands.where("NOT _whole").select(*rest), invoice_key, tie_order))
    ikey = list(invoice_key)
    order = _order_cols(tie_order)
    second = (F.year("bank_date") * 12 + F.month("bank_date")) if tie_order == "date" else F.col("bank_statement_id")
    # one key without nulls or doubles: the candidates are dealt out by it once, for
    # the counts and the ranks alike (both read the same columns), and the join keeps that
    step = F.lit(0.0) - F.col("match_score")
    cut = cands.withColumn("_cut", F.struct(F.struct(*ikey).alias("of"), step.cast("string").alias("step"), second.alias("part"))) \
        .drop(*ikey)
    ranked = cut.withColumn("_own", F.row_number().over(Window.partitionBy("_cut").orderBy(*order)))
    before = Window.partitionBy("_cut.of").orderBy("_step", "_cut.part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranked.groupBy("_cut").agg(F.max("_own").alias("_n"), F.min(step).alias("_step"))
    offsets = counts.select("_cut", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # every part has its offset; a left join cannot broadcast the candidates
    return ranked.join(offsets, "_cut", "left").select(
        *[F.col("_cut.of")[c].alias(c) if c in ikey else F.col(c) for c in cands.columns],
        (F.col("_off") + F.col("_own")).cast("long").alias("rank"))


def _order_cols(tie_order: str):
    return [F.col("match_score").desc(), *[F.col(c).asc() for c in _ORDER["date" if tie_order == "date" else "row"]]]
