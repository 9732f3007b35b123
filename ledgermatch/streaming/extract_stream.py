"""Invoice text files arriving in a folder -> invoice field rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.extraction import extract_invoices
from ..session import shared_root


def extract_invoice_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming DataFrame of extracted invoices from text files dropped
    into ``source_dir`` (each file one document)."""
    docs = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger) \
        .text(source_dir, wholetext=True) \
        .select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text"))
    return extract_invoices(docs).drop("raw_text")


def start_invoice_stream(df: DataFrame, sink_path: str, name: str = "invoices",
                         checkpoint_location: str | None = None):
    """Append the stream to parquet. The progress is kept in
    ``checkpoint_location``, or under the shared ``spark.checkpoint.dir`` in a
    folder that only ``name`` decides, so that a restart goes on where the
    last session stopped; one of the two must be set."""
    root = shared_root(df.sparkSession)
    if not checkpoint_location and not root:
        raise ValueError("set checkpoint_location or spark.checkpoint.dir: a stream's progress needs a lasting folder")
    loc = checkpoint_location or f"{root.rstrip('/')}/stream-{name}"
    return df.writeStream.format("parquet").option("path", sink_path) \
        .option("checkpointLocation", loc).outputMode("append").start()
