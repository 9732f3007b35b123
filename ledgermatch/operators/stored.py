"""Flag joins of stored results (J4, J5, J6): tables laid out by the match keys.

A table is stored in buckets of its key columns, sorted by them, and the keys
of the used side alike. The flag joins read bucket against bucket: no side is
shuffled again, however often the flags are asked for.

A key may hold a large share of all rows (one subscription's payments). Rows
are therefore dealt over ``salts`` by a hash of the whole row, the salt is
part of the bucket, and the used side, which is distinct, holds each key once
a salt. A bucket then holds a ``salts``-th of the hottest key at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .flags import _inv_key_cols, _txn_key_cols, used_transaction_keys

SALT = "_k_salt"
TXN_KEYS = ["_k_date", "_k_amt", "_k_desc"]
INV_KEYS = ["_k_file", "_k_num", "_k_amt"]


def store_by(df: DataFrame, table: str, keys: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """``df`` as the table ``table``, in ``buckets`` buckets of ``keys``, each
    sorted by them; one file a bucket. ``path``: a folder for the files outside
    the warehouse."""
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def _salted(df: DataFrame, salts: int) -> DataFrame:
    return df.withColumn(SALT, F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))


def _each_salt(df: DataFrame, salts: int) -> DataFrame:
    return df.withColumn(SALT, F.explode(F.array(*[F.lit(i) for i in range(salts)])))


def _file_as_text(df: DataFrame) -> DataFrame:
    """Buckets take no structs: a file's name and path as JSON, null ones left out."""
    return df.withColumn("_k_file", F.to_json(F.struct("_k_file")))


def store_transactions(transactions: DataFrame, table: str, buckets: int = 64, salts: int = 8, path: str | None = None) -> DataFrame:
    """Transactions with their key columns, for ``flag_stored``."""
    keyed = transactions.select("*", *_txn_key_cols("date", "amount", "description"))
    return store_by(_salted(keyed, salts), table, [*TXN_KEYS, SALT], buckets, path)


def store_used_transactions(matches: DataFrame, table: str, buckets: int = 64, salts: int = 8, path: str | None = None) -> DataFrame:
    """The keys of the transactions that matches used. ``buckets`` and
    ``salts`` as those of the transactions."""
    return store_by(_each_salt(used_transaction_keys(matches), salts), table, [*TXN_KEYS, SALT], buckets, path)


def store_invoices(invoices: DataFrame, table: str, buckets: int = 64, salts: int = 8, by_path: bool = False,
                   path: str | None = None) -> DataFrame:
    """Invoices with their key columns; ``by_path``: files of one name are told apart by their path."""
    keyed = _file_as_text(invoices.select("*", *_inv_key_cols(invoices, by_path)))
    return store_by(_salted(keyed, salts), table, [*INV_KEYS, SALT], buckets, path)


def store_matched_invoices(matches: DataFrame, table: str, buckets: int = 64, salts: int = 8, by_path: bool = False,
                           path: str | None = None) -> DataFrame:
    """The keys of the matched invoices, as ``store_invoices`` lays them out."""
    keys = _file_as_text(matches.where("matched").select(*_inv_key_cols(matches, by_path))).distinct()
    return store_by(_each_salt(keys, salts), table, [*INV_KEYS, SALT], buckets, path)


def flag_stored(rows: DataFrame, used: DataFrame) -> DataFrame:
    """J4 / J5 on two tables of this module: ``rows`` with ``matched``. Rows
    with a null in their key are not matched."""
    keys = used.columns
    out = rows.join(used.withColumn("_hit", F.lit(True)), keys, "left")
    return out.withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit", *keys)


def unused_stored(rows: DataFrame, used: DataFrame) -> DataFrame:
    """J6 on two tables of this module: the rows of no used key."""
    return rows.join(used, used.columns, "left_anti").drop(*used.columns)
