"""Format routing by file extension (S5) and source union."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Extension -> reader family.
FORMATS = {"pdf": "pdf", "xlsx": "excel", "xls": "excel", "csv": "csv"}


def route_by_extension(files: DataFrame, name_col: str = "filename") -> DataFrame:
    """Adds ``extension``, ``format`` (pdf / excel / csv) and
    ``reject_reason`` for unsupported extensions (kept as rows, not errors)."""
    ext = F.when(F.instr(F.col(name_col), ".") > 0,
                 F.lower(F.substring_index(F.col(name_col), ".", -1))).otherwise(F.lit(""))
    fmt = None
    for e, f in FORMATS.items():
        fmt = F.when(ext == e, F.lit(f)) if fmt is None else fmt.when(ext == e, F.lit(f))
    return files.withColumn("extension", ext).withColumn("format", fmt) \
        .withColumn("reject_reason", F.when(F.col("format").isNull(),
                                            F.concat(F.lit("unsupported format: "), F.col(name_col))))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """The inventory of statement files: statement_id (full path, as the
    readers name it), length, extension, format and reject_reason
    (unsupported or empty files). No file is opened.

    Sources give no rows for empty files; those are the names of the listing,
    which the driver makes for any file source, that no row has."""
    read = spark.read.format("binaryFile").load(path)
    sized = read.select(F.col("_metadata.file_path").alias("statement_id"), F.col("_metadata.file_size").alias("length"))
    listed = spark.createDataFrame([(name,) for name in read.inputFiles()], "name string")
    # the listing may write a missing host as ``file:///a``, a row's path as ``file:/a``
    names = listed.select(F.regexp_replace("name", r"^([^:/]+):///", "$1:/").alias("statement_id"))
    found = names.join(sized, "statement_id", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    routed = route_by_extension(found, "statement_id")
    return routed.withColumn("reject_reason", F.coalesce("reject_reason", F.when(F.col("length") == 0, F.lit("empty file"))))


def supported(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` of the statements that an inventory does not refuse."""
    refused = files.where(F.col("reject_reason").isNotNull()).select("statement_id")
    return rows.join(refused, "statement_id", "left_anti")


def union_sources(grid_tx: DataFrame, line_tx: DataFrame) -> DataFrame:
    """Grid transactions plus the line transactions that no grid row of
    the same statement repeats (date, amount and description without blanks
    and case); ``row_source`` tells which."""
    cols = ["statement_id", "row_idx", "date", "description", "amount"]
    bare = F.lower(F.regexp_replace("description", r"[\s\p{Z}]+", ""))
    g = grid_tx.select(*cols).withColumn("row_source", F.lit("grid"))
    seen = g.select("statement_id", "date", "amount", bare.alias("_bare")).distinct()
    lines = line_tx.select(*cols).withColumn("_bare", bare) \
        .join(seen, on=["statement_id", "date", "amount", "_bare"], how="left_anti") \
        .select(*cols).withColumn("row_source", F.lit("lines"))
    return g.unionByName(lines)
