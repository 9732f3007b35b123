"""Uniform shuffle of all documents into shards of exact size, by a drawn communication matrix.

Rows are dealt to source partitions by a hash of doc_id and text. One narrow pass counts them; the counts alone go to
the driver, which draws how many rows each partition sends to each shard: for one partition after the other a
multivariate hypergeometric sample of what the shards still lack. Every row of the matrix sums to its partition and
every column to its shard, and the matrix is distributed as a uniform shuffle makes it. Then each partition is permuted
locally by a keyed hash and cut at the drawn counts, the rows are exchanged, and each shard is permuted again. A shard
is permuted in cells (a keyed hash of the row picks the cell, another one the place in it), so that no task holds a
whole shard; the sizes of the cells before it place a cell's slots.

Only DataFrame functions touch rows. All choices are functions of the row and the seed, so a lost executor's tasks
repeat them. Shard sizes differ by one row at most and add up to all rows.

Results at the edges: null doc_ids and texts are hashed like values; fully repeated rows are kept, each with its own
slot (which of two equal rows has which one is open); columns named like an output are replaced; an empty table gives
no rows. All rows of one doc_id *and* text meet in one task of the local permutation, which sorts them with spilling.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

MAX_PARTITIONS = 65_536  # rows of the matrix that the driver draws
CELL_ROWS = 1_000  # mean rows of a cell
PART_ROWS = 5_000  # mean rows of a source partition, until there are MAX_PARTITIONS
TASK_ROWS = 20_000  # mean rows of a task of either permutation


def draw_one(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Hypergeometric sample by inversion around the mode; numpy's own stops at 10^9 rows."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = (draws + 1) * (good + 1) // (total + 2)
    wide = int(12 * (draws * (good / total) * (bad / total) * max(total - draws, 1) / max(total - 1, 1)) ** 0.5) + 40
    low, high = max(low, mode - wide), min(high, mode + wide)
    k = np.arange(low, high, dtype=np.float64)  # log p(k + 1) - log p(k)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def draw_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows sent from each partition (of ``counts`` rows) to each shard (of ``sizes`` rows)."""
    if sum(counts) != sum(sizes):
        raise ValueError("partitions and shards must hold the same number of rows")
    rng, lack, matrix = np.random.default_rng(seed), list(sizes), []
    for n in counts:
        rest, sent = sum(lack), []
        for s, open_rows in enumerate(lack):
            got = draw_one(rng, open_rows, rest - open_rows, n)
            sent.append(got)
            rest -= open_rows
            n -= got
            lack[s] -= got
        matrix.append(sent)
    return matrix


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _rows(spark: SparkSession, values: list, schema: str) -> DataFrame:
    """A few driver-side values as a DataFrame, by SQL functions alone."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(values)), f"array<struct<{schema}>>")).alias("v")
                                 ).select("v.*")


def _key(row: str, seed: int, what: int) -> Column:
    return F.xxhash64(F.col(row), F.lit(seed), F.lit(what))


def shuffle_into_shards(spark: SparkSession, docs: DataFrame, shards: int = 8, seed: int = 0,
                        partitions: int | None = None, cell_rows: int = CELL_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """All columns of ``docs`` plus ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... without gaps in each shard).

    ``partitions``: source partitions, by default four for each shuffle partition of the session, and more for tables
    of over PART_ROWS rows a partition. The tasks of both permutations grow in number with the rows, not in size.
    """
    docs = docs.select([c for c in docs.columns if c.lower() not in ("shard", "slot")])
    total, least = docs.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))  # Parquet counts without reading rows
    parts = min(partitions or max(4 * least, -(-total // PART_ROWS)), MAX_PARTITIONS)
    tasks = max(least, -(-total // task_rows))
    rows = docs.withColumn("__row", F.xxhash64("doc_id", "text", F.lit(seed))) \
        .withColumn("__part", F.pmod(_key("__row", seed, 1), F.lit(parts)).cast("int"))

    counted = {r["__part"]: r["count"] for r in rows.groupBy("__part").count().collect()}  # at most MAX_PARTITIONS rows
    order = sorted(counted)
    matrix = draw_matrix([counted[p] for p in order], shard_sizes(total, shards), seed)
    bounds = _rows(spark, [{"__part": p, "__ends": np.cumsum(sent).tolist()} for p, sent in zip(order, matrix)],
                   "__part: int, __ends: array<bigint>")

    local = Window.partitionBy("__part").orderBy(_key("__row", seed, 2), "__row", "doc_id")
    place = F.row_number().over(local)
    sent = rows.repartition(tasks, "__part").withColumn("__place", place).join(F.broadcast(bounds), "__part") \
        .withColumn("shard", F.size(F.filter("__ends", lambda end: end < F.col("__place"))))

    cells = max(1, -(-total // (shards * cell_rows)))
    sent = sent.withColumn("__cell", F.pmod(_key("__row", seed, 3), F.lit(cells)))
    sizes = sent.groupBy("shard", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("shard", "__cell", (F.sum("__n").over(
        Window.partitionBy("shard").orderBy("__cell")) - F.col("__n")).alias("__base"))
    again = Window.partitionBy("shard", "__cell").orderBy(_key("__row", seed, 4), "__row", "doc_id")
    return sent.repartition(tasks, "shard", "__cell").withColumn("__again", F.row_number().over(again)).join(before, ["shard", "__cell"]) \
        .withColumn("slot", F.col("__base") + F.col("__again") - 1).select(*docs.columns, "shard", "slot")


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order within each file."""
    shuffled.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
