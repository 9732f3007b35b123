"""Table reading. Partitioning is the reader's and the caller's choice: no operator repartitions its inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A Parquet table; ``partitions`` deals its rows out anew, for files of few and large row groups."""
    df = spark.read.parquet(path)
    return df if partitions is None else df.repartition(partitions)
