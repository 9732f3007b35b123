"""Connected components of an edge table by alternating large-star and small-star steps.

Each round is a few aggregations and joins over the edges and is written below spark.checkpoint.dir, so lineage stays
short and nothing but a row count and a checksum reaches the driver. So are the minima that a step joins back: both
sides of that join are then plain exchanges, which adaptive execution splits where one node holds most edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import shared_path


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (columns a, b of one orderable type); label: the smallest node."""
    now = _written(spark, edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a"))
                   .where("a <> b").select("a", "b").distinct())
    mark = _checksum(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _written(spark, both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = _written(spark, large)  # every edge points from the larger to the smaller end
        low = _written(spark, large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .union(low.select("a", F.col("m").alias("b"))).distinct()
        now = _written(spark, small)
        last, mark = mark, _checksum(now)
        if mark == last:
            break
    labels = now.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())


def _written(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = shared_path(spark, "edges")
    df.write.parquet(path)
    return spark.read.parquet(path)


def _checksum(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
