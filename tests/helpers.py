"""Helpers that the tests import by name."""


def one_col(spark, values, expr, schema="s string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr(df.columns[0]).alias("x")).collect()]
