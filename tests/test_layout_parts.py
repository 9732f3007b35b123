"""Rows of one header list are dealt over tasks, and lists are read once."""

from pyspark.sql import functions as F

from ledgermatch.operators.columns import detect_columns
from ledgermatch.operators.statements import harmonise
from ledgermatch.sources import delimited as D

HEADS = ["Date", "Libellé", "Montant"]


def _rows(spark, heads, n=2000):
    cells = F.array(F.lit("05/01/2024"), F.concat(F.lit("VIR "), F.col("id")), F.lit("12,50"))
    return spark.range(n).select(F.lit("s").alias("statement_id"), F.col("id").alias("row_idx"),
                                 F.when(F.col("id") >= 0, F.array(*map(F.lit, heads))).alias("headers"), cells.alias("cells"))


def _plain(spark):
    """No adaptive plan and no broadcast by a guessed size; what to restore."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    return was


def test_one_layout_is_many_tasks(spark):
    told = spark.createDataFrame([("s", "zq0", "zq1", "zq2", None, None)], "statement_id string, date_column string, "
                                 "description_column string, amount_column string, debit_column string, credit_column string")
    was = _plain(spark)
    try:
        for heads, suggestions in ((HEADS, None), (["zq0", "zq1", "zq2"], told)):
            out = harmonise(_rows(spark, heads), suggestions=suggestions)
            got = out.where("amount = 12.50 AND date IS NOT NULL").groupBy(F.spark_partition_id()).count().collect()
            assert sum(r["count"] for r in got) == 2000
            assert max(r["count"] for r in got) < 1000  # all 2,000 when joined by the headers alone
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_layouts_are_read_once(spark):
    was = _plain(spark)
    try:
        found = detect_columns(_rows(spark, HEADS))
        plan = found._jdf.queryExecution().executedPlan().toString()
        # everything below a reused exchange is run once
        assert plan.count("ReusedExchange") >= 2, plan
        assert found.collect()[0]["amount_idx"] == 2
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_one_statement_is_many_tasks(spark):
    """Lines of one long statement meet their header in many tasks, also under a trial of separators."""
    head = spark.createDataFrame([("s", 0, "Date;Libellé, suite;Montant")], "statement_id string, line_no long, line string")
    below = spark.range(1, 2001).select(F.lit("s").alias("statement_id"), (F.col("id") * (D.PART_LINES // 50)).alias("line_no"),
                                        F.concat(F.lit('05/01/2024;VIR 5" '), F.col("id"), F.lit(";12,50")).alias("line"))
    lines = spark.createDataFrame(head.unionByName(below).collect(), "statement_id string, line_no long, line string").repartition(4)
    was = _plain(spark)
    try:
        heads = D.header_lines(lines)
        for out in (D.delimited_to_rows(lines), D._below(lines, heads, "seps"), D._below(lines, D.sniff_separator(lines), "sep")):
            got = out.groupBy(F.spark_partition_id()).count().collect()
            assert sum(r["count"] for r in got) == 2000
            assert max(r["count"] for r in got) < 1000  # all 2,000 when joined by the statement alone
        assert D.sniff_separator(lines).collect()[0]["sep"] == ";"
        kept = {tuple(r["cells"]) for r in D.delimited_to_rows(lines).collect()}
        assert kept == {("05/01/2024", f'VIR 5" {i}', "12,50") for i in range(1, 2001)}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
