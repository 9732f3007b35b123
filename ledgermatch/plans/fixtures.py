"""Views derived from the driver's tables (FIXTURES.md part B).

Every view is a deterministic projection of ``orders`` (plus ``lineitem`` /
``conversations`` where stated), so its size grows with the scale factor and
the DuckDB oracle can build the same rows from the same parquet files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.amounts import AMOUNT_TYPE, format_en_amount, format_fr_amount


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of a task that renders or parses text.
TASK_ROWS = 250_000


def base(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The columns a view needs, dealt over the session's cores: the test
    files are single row groups, and rendering text is work per row. Tasks grow
    in number with the rows (counted from the footers), not in size."""
    rows = table(spark, sf_dir, name).select(*cols)
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return rows.repartition(tasks, *cols)


def _cents(x) -> F.Column:
    return F.round(x * 100).cast("bigint")


def _amount(cents) -> F.Column:
    return (cents.cast("decimal(20,0)") / 100).cast(AMOUNT_TYPE)


def inv_v(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return base(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_totalprice", "o_custkey").select(
        k.alias("k"),
        F.concat(F.lit("inv_"), k, F.lit(".pdf")).alias("filename"),
        F.when(k % 11 != 0, F.concat(F.lit("INV-"), k)).alias("invoice_number"),
        F.when(k % 13 != 0, F.to_date("o_orderdate")).alias("invoice_date"),
        F.when(k % 17 != 0, _amount(_cents(F.col("o_totalprice")))).alias("total_amount"),
        F.lit("EUR").alias("currency"),
        F.col("o_custkey"))


def _txn_base(spark, sf_dir) -> DataFrame:
    """One transaction per order; those of every third key lie 200 days
    later, outside the window of their invoice."""
    k = F.col("o_orderkey")
    cents = (_cents(F.col("o_totalprice")) + (k % 7 - 3)) * F.when(k % 2 == 0, -1).otherwise(1)
    days = k % 120 + F.when(k % 3 == 0, 200).otherwise(0)
    return base(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").select(
        F.concat(F.lit("st_"), F.col("o_custkey") % 4).alias("statement_id"),
        k.alias("row_idx"),
        F.date_add(F.to_date("o_orderdate"), days.cast("int")).alias("date"),
        F.concat(F.lit("VIR INV-"), k, F.lit(" CLIENT")).alias("description"),
        cents.alias("cents"))


def txn_v(spark, sf_dir) -> DataFrame:
    return _txn_base(spark, sf_dir).select(
        "statement_id", "row_idx", "date", "description", _amount(F.col("cents")).alias("amount"))


def section_text(k, custkey, orderdate, total) -> F.Column:
    """The five-line invoice section template of FIXTURES.md."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Facture N° INV-"), k),
        F.concat(F.lit("SOCIETE SUP "), k % 100),
        F.concat(F.lit("CLIENT CUS "), custkey),
        F.concat(F.lit("Date de facture : "), F.date_format(orderdate, "dd/MM/yyyy")),
        F.concat(F.lit("Total TTC : "), format_fr_amount(total), F.lit(" EUR")))


def invtext_v(spark, sf_dir) -> DataFrame:
    """Two invoice sections per document, joined by a newline in key order."""
    o = base(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    sec = o.select(
        F.col("o_orderkey").alias("k"),
        F.concat(F.lit("doc_"), F.floor(F.col("o_orderkey") / 2).cast("bigint"), F.lit(".pdf")).alias("filename"),
        section_text(F.col("o_orderkey"), F.col("o_custkey"), F.to_date("o_orderdate"),
                     _amount(_cents(F.col("o_totalprice")))).alias("sec"))
    return sec.groupBy("filename").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "sec"))),
                                 lambda x: x["sec"]), "\n").alias("text"))


def lines_v(spark, sf_dir) -> DataFrame:
    t = _txn_base(spark, sf_dir)
    amt = format_fr_amount(_amount(F.col("cents")))
    line = F.when(F.col("row_idx") % 10 == 0, F.concat(F.lit("SOLDE REPORTE "), amt)).otherwise(
        F.concat_ws(" ", F.date_format("date", "dd/MM/yyyy"), F.col("description"), amt))
    return t.select("statement_id", F.col("row_idx").alias("line_no"), line.alias("line"))


# The four statement layouts of the derived cells view.
LAYOUTS = {
    "st_0": ["Date", "Libellé", "Montant"],
    "st_1": ["Booking Date", "Label", "Débit", "Crédit"],
    "st_2": ["Date opération", "Narration", "Amount", "Debit", "Credit", "Solde"],
    "st_3": ["Valeur", "Détails", "Debit", "Credit"],
}


def _headers(sid) -> F.Column:
    out = F.array(*map(F.lit, LAYOUTS["st_3"]))
    for name in ("st_2", "st_1", "st_0"):
        out = F.when(sid == name, F.array(*map(F.lit, LAYOUTS[name]))).otherwise(out)
    return out


def heads_v(spark, sf_dir) -> DataFrame:
    """The statements of ``cells_v`` and their headers."""
    found = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("st_"), F.col("o_custkey") % 4).alias("statement_id")).distinct()
    return found.withColumn("headers", _headers(F.col("statement_id")))


def cells_v(spark, sf_dir) -> DataFrame:
    t = _txn_base(spark, sf_dir)
    amount = _amount(F.col("cents"))
    fr = format_fr_amount(amount)
    fr_abs = format_fr_amount(F.abs(amount))
    debit = F.when(F.col("cents") < 0, fr_abs).otherwise(F.lit(""))
    credit = F.when(F.col("cents") > 0, fr_abs).otherwise(F.lit(""))
    dmy = F.date_format("date", "dd/MM/yyyy")
    iso = F.date_format("date", "yyyy-MM-dd")
    sid = F.col("statement_id")
    split = F.col("row_idx") % 5 == 0  # rows of st_2 that fill debit or credit instead of the amount
    cells = F.when(sid == "st_0", F.array(dmy, F.col("description"), fr)) \
        .when(sid == "st_1", F.array(iso, F.col("description"), debit, credit)) \
        .when(sid == "st_2", F.array(dmy, F.col("description"), F.when(split, F.lit("")).otherwise(format_en_amount(amount)),
                                     F.when(split, debit).otherwise(F.lit("")), F.when(split, credit).otherwise(F.lit("")),
                                     F.lit("0,00"))) \
        .otherwise(F.array(iso, F.col("description"), debit, credit))
    return t.select("statement_id", "row_idx", _headers(sid).alias("headers"), cells.alias("cells"))


def grid_v(spark, sf_dir) -> DataFrame:
    """Headerless grid per statement: title rows (one non-empty cell), the
    header row at position 1, 4, 7 or 10 by statement, then the data rows in
    key order (positions increase; gaps are allowed)."""
    c = cells_v(spark, sf_dir)
    data = c.select("statement_id", (F.col("row_idx") + 11).cast("long").alias("row_idx"), "cells")
    heads = heads_v(spark, sf_dir).withColumn(
        "at", F.substring("statement_id", 4, 1).cast("long") * 3 + 1)
    title = heads.select("statement_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("at") - 1)).alias("row_idx"),
                         F.array(F.concat(F.lit("RELEVE "), F.col("statement_id")), F.lit(""), F.lit("")).alias("cells"))
    header = heads.select("statement_id", F.col("at").alias("row_idx"), F.col("headers").alias("cells"))
    return title.unionByName(header).unionByName(data)


def resp_v(spark, sf_dir) -> DataFrame:
    """Free-text model answers: a JSON object for even order keys (amounts as
    text or as JSON numbers), no JSON for odd ones."""
    i = inv_v(spark, sf_dir)
    k = F.col("k")
    q = F.lit('"')
    number = F.when(k % 5 == 0, F.lit("null")).otherwise(F.concat(q, F.lit("LLM-"), k, q))
    date = F.concat(q, F.coalesce(F.date_format("invoice_date", "yyyy-MM-dd"), F.lit("")), q)
    total = F.when(F.col("total_amount").isNotNull() & (k % 4 == 2), F.col("total_amount").cast("string")) \
        .otherwise(F.concat(q, F.coalesce(format_fr_amount(F.col("total_amount")), F.lit("")), q))
    js = F.concat(F.lit('{"invoice_number":'), number, F.lit(',"invoice_date":'), date,
                  F.lit(',"total_amount":'), total, F.lit(',"currency":"eur"}'))
    js = F.when(k % 6 == 0, F.concat(F.lit('{"facture":'), js, F.lit("}"))).otherwise(js)  # nested
    answer = F.when(k % 2 == 0, F.concat(F.lit("Voici : "), js, F.lit(" fin"))).when(k % 4 == 1, F.lit("Je ne sais pas"))
    return i.select("k", "filename", answer.alias("answer"))


def inv_o(spark, sf_dir) -> DataFrame:
    """Orders as invoices (every field present)."""
    k = F.col("o_orderkey")
    return base(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_totalprice").select(
        k.alias("k"), F.concat(F.lit("ord_"), k, F.lit(".pdf")).alias("filename"),
        F.concat(F.lit("INV-"), k).alias("invoice_number"), F.to_date("o_orderdate").alias("invoice_date"),
        _amount(_cents(F.col("o_totalprice"))).alias("total_amount"))


def txn_l(spark, sf_dir) -> DataFrame:
    """Line items as bank transactions (competing candidates per order)."""
    return base(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey",
                "l_extendedprice").select(
        F.lit("li").alias("statement_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_idx"),
        F.to_date("l_shipdate").alias("date"),
        F.concat(F.lit("PAY INV-"), F.col("l_orderkey"), F.lit(" P"), F.col("l_partkey")).alias("description"),
        _amount(_cents(F.col("l_extendedprice"))).alias("amount"))
