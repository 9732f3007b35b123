"""Match flags and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.amounts import AMOUNT_TYPE
from ..functions.text import ktrim


def _inv_key_cols(df: DataFrame, by_path: bool):
    return [F.struct("filename", "path").alias("_k_file") if by_path else F.col("filename").alias("_k_file"),
            F.coalesce(F.lower(ktrim("invoice_number")), F.lit("")).alias("_k_num"),
            F.coalesce(F.col("total_amount").cast(AMOUNT_TYPE).cast("string"), F.lit("")).alias("_k_amt")]


def _txn_key_cols(date, amount, description):
    return [F.col(date).alias("_k_date"), F.col(amount).cast(AMOUNT_TYPE).alias("_k_amt"),
            F.regexp_replace(F.lower(F.col(description)), r"[\s\p{Z}]", "").alias("_k_desc")]


def mark_invoices(invoices: DataFrame, matches: DataFrame) -> DataFrame:
    """``matched`` = the invoice's (filename, number, total) key belongs
    to a matched result row; where both sides have ``path``, files of one
    name in different folders are told apart by it (a null path is a value)."""
    by_path = "path" in invoices.columns and "path" in matches.columns
    keys = matches.where("matched").select(*_inv_key_cols(matches, by_path)).distinct() \
        .withColumn("_hit", F.lit(True))
    inv = invoices.select("*", *_inv_key_cols(invoices, by_path))
    out = inv.join(keys, on=["_k_file", "_k_num", "_k_amt"], how="left")
    return out.withColumn("matched", F.coalesce(F.col("_hit"), F.lit(False))) \
        .drop("_k_file", "_k_num", "_k_amt", "_hit")


def used_transaction_keys(matches: DataFrame) -> DataFrame:
    ok = (F.col("matched") & F.col("bank_date").isNotNull() & F.col("bank_amount").isNotNull()
          & (F.trim(F.coalesce(F.col("bank_description"), F.lit(""))) != ""))
    return matches.where(ok).select(*_txn_key_cols("bank_date", "bank_amount", "bank_description")).distinct()


def mark_transactions(transactions: DataFrame, matches: DataFrame) -> DataFrame:
    """``matched`` = (date, amount, description without blanks) equals a
    used transaction's key; identical twins are all marked."""
    keys = used_transaction_keys(matches).withColumn("_hit", F.lit(True))
    tx = transactions.select("*", *_txn_key_cols("date", "amount", "description"))
    out = tx.join(keys, on=["_k_date", "_k_amt", "_k_desc"], how="left")
    return out.withColumn("matched", F.coalesce(F.col("_hit"), F.lit(False))) \
        .drop("_k_date", "_k_amt", "_k_desc", "_hit")


def unused_transactions(transactions: DataFrame, matches: DataFrame) -> DataFrame:
    """Transactions no invoice was matched to (left anti join)."""
    keys = used_transaction_keys(matches)
    tx = transactions.select("*", *_txn_key_cols("date", "amount", "description"))
    return tx.join(keys, on=["_k_date", "_k_amt", "_k_desc"], how="left_anti") \
        .drop("_k_date", "_k_amt", "_k_desc")


def summary_invoices(flagged_invoices: DataFrame) -> DataFrame:
    """Invoice summary without the raw text."""
    return flagged_invoices.drop("raw_text")


def unmatched_invoices(flagged_invoices: DataFrame) -> DataFrame:
    """P10: invoices without a payment."""
    return flagged_invoices.where(~F.col("matched"))


def summary_counts(flagged_invoices: DataFrame, flagged_transactions: DataFrame) -> DataFrame:
    """A3: one row of run counts, from one aggregation over both flagged
    tables (no join)."""
    both = flagged_invoices.select(F.lit("i").alias("_kind"), "matched") \
        .unionByName(flagged_transactions.select(F.lit("t").alias("_kind"), "matched"))
    inv, txn = F.col("_kind") == "i", F.col("_kind") == "t"
    return both.agg(
        F.count_if(inv).alias("invoices"),
        F.count_if(inv & F.col("matched")).alias("invoices_matched"),
        F.count_if(inv & ~F.col("matched")).alias("invoices_unmatched"),
        F.count_if(txn).alias("transactions"),
        F.count_if(txn & F.col("matched")).alias("transactions_used"))


def observed_counts(flagged_invoices: DataFrame, flagged_transactions: DataFrame):
    """A3 while something else reads the rows: both tables with the counts of
    ``summary_counts`` as observations, and a function that gives them as a
    dict once one action has read each table (it waits until then).

    The counts belong to the first action. Let that be a plain write or
    collect: counting then runs in the action's last stage, of which Spark
    counts each task once, also when it was retried."""
    inv, txn = Observation("invoices"), Observation("transactions")
    hit = F.coalesce(F.col("matched"), F.lit(False))
    invoices = flagged_invoices.observe(inv, F.count(F.lit(1)).alias("invoices"), F.count_if(hit).alias("invoices_matched"))
    transactions = flagged_transactions.observe(txn, F.count(F.lit(1)).alias("transactions"),
                                                F.count_if(hit).alias("transactions_used"))

    def counts() -> dict[str, int]:
        i, t = inv.get, txn.get
        return {"invoices": i["invoices"], "invoices_matched": i["invoices_matched"],
                "invoices_unmatched": i["invoices"] - i["invoices_matched"], **t}

    return invoices, transactions, counts
