"""Document text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (path, filename, text); ``path`` tells files of one
    name apart. Byte decoding of PDFs is not part of the library; feed
    extracted text files or any table with a text column. A document is one
    row: sections are split in its whole text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("filename"),
        F.col("value").alias("text"))


def concat_pages(pages: DataFrame, doc_col: str, page_col: str, text_col: str = "text",
                 sep: str = "\n") -> DataFrame:
    """The pages of each document joined by a newline in page order.
    The result row is the document itself, so its size is the document's."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page_col).alias("p"),
                                                   F.coalesce(F.col(text_col), F.lit("")).alias("t"))))
    return pages.groupBy(doc_col).agg(
        F.array_join(F.transform(ordered, lambda x: x["t"]), sep).alias("text"),
        F.count(F.lit(1)).alias("n_pages"))
