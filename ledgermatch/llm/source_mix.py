"""Mixing sources to target weights: equal-token blocks, apportioned to sources by Sainte-Laguë's highest quotients.

1. One pass over the documents counts words and writes narrow rows (no texts). Sources and their sizes follow from them.
2. Targets: sources share ``share`` times all words by weight; a source stops at ``most`` times its size, and what it
   leaves is reshared by weight among the others. The fixed point is one level per unit of weight: sources ordered by
   size over weight stop while their own level lies below that of the rest, so prefix sums give it without rounds.
3. A source's documents stand in a seeded order, and its words are cut into n = ceil(size / ``block``) blocks of equal
   size (to one word). A target is a number of blocks, and the blocks of the whole mix are numbered by falling quotient
   target / (2k + 1): Sainte-Laguë's order. It is house-monotone, so that cutting the order into equal runs gives every
   shard its integer quota of each source, and the quotas add up to the apportionment of the whole. The quotients are not
   listed: a divisor a little too large gives seats that every apportionment of this house holds, one a little too small
   bounds them from above, and the two or three quotients a source between them are ranked.
4. A source with quota q takes q of its blocks: all of them q div n times, and q mod n once more by a seeded stride
   permutation of the block numbers. A document's share follows from its place in the source's words, by arithmetic.

Every document is placed by prefix sums in two levels: cells of about ``cell_rows`` rows by the seeded hash, cell sums,
then places inside a cell. No task holds a whole source. All choices are functions of rows and seed, so lost executors'
tasks repeat them, and reruns agree. Only DataFrame functions touch rows.

Bounds: the table of sources (a few numbers a source and shard) is ordered and ranked in one task; it is written, so
that its join with the documents is broadcast only where its files' size allows, and else a shuffled, skew-split one.

Results at the edges: null and empty texts have size 0 and nothing of them is taken; a null source is a source of its
own, last in order; null doc_ids are hashed like values; fully repeated rows are kept, each with its own place (which of
two equal rows has which one is open); sources without words have target 0; other
columns of the input are ignored unless carried, and carried ones named like an output are replaced; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import shared_path

WEIGHTS = (5, 2, 1)
SHARE_HALVES = 3  # the mix holds 3/2 of all words
MOST = 2
BLOCK = 64
SHARDS = 8
CELL_ROWS = 2_000
#: Primes of the stride permutation; one that does not divide a source's number of blocks is a permutation of them.
STRIDES = (99_991, 99_989, 99_971)
WORD = "[^\\x20\\x09-\\x0D]+"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: int, *values: Column) -> Column:
    """128 seeded bits of some strings (null apart from empty) as hexadecimal text."""
    marked = [F.coalesce(F.concat(F.lit("+"), v), F.lit("-")) for v in values]
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *marked))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_halves: int = SHARE_HALVES, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size) plus ``number`` and ``weight`` (sources by code point, null last) and ``target``."""
    given = F.array(*[F.lit(int(w)) for w in weights])
    known = sizes.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) \
        .withColumn("weight", F.get(given, F.col("number") % len(weights)).cast("long"))
    cap = F.col("source_size") * most
    stops = Window.orderBy((cap / F.col("weight")).asc(), "number")
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rest = F.col("all2") - 2 * F.col("capped")  # twice the words left, for the weight left
    found = known.withColumn("cap", cap) \
        .withColumn("all2", share_halves * F.sum("source_size").over(every)) \
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0))) \
        .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))) \
        .withColumn("open", 2 * F.col("cap") * F.col("left") > rest * F.col("weight")) \
        .withColumn("n_open", F.row_number().over(stops))
    first = F.min(F.when(F.col("open"), F.struct("n_open", rest.alias("rest"), "left"))).over(every)
    return found.withColumn("first", first).select(
        *sizes.columns, "number", "weight",
        F.when(F.col("first").isNull() | (F.col("n_open") < F.col("first.n_open")), F.col("cap").cast("double"))
        .otherwise((F.col("weight") * F.col("first.rest")).cast("double") / (2 * F.col("first.left"))).alias("target"))


def quotas(goals: DataFrame, block: int = BLOCK, shards: int = SHARDS, most: int = MOST, seed: int = 0) -> DataFrame:
    """``goals`` plus ``n_blocks`` of ``words`` or (the first ``longer``) ``words + 1`` words, ``offset`` and ``stride`` of
    their permutation, and ``ends``: how many blocks the shards up to each one take of the source."""
    every = Window.partitionBy()
    seats = F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0)
    known = goals.withColumn("n_blocks", F.expr(f"(source_size + {block - 1}) div {block}")).withColumn("seats", seats) \
        .withColumn("total", F.sum("seats").over(every)).withColumn("house", F.round("total").cast("long")) \
        .withColumn("parties", F.count(F.when(F.col("seats") > 0, 1)).over(every))
    by_shard = known.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards)))) \
        .withColumn("part", F.expr(f"house * shard div {shards}"))

    def at(house: Column) -> Column:  # seats by the divisor total / house, within the copies of the source's blocks
        got = F.floor(F.col("seats") * F.greatest(house, F.lit(0)) / F.greatest(F.col("total"), F.lit(1e-300)) + 0.5)
        return F.least(got.cast("long"), most * F.col("n_blocks"))
    by_shard = by_shard.withColumn("low", at(F.col("part") - F.col("parties") / 2 - 1)) \
        .withColumn("high", at(F.col("part") + F.col("parties") / 2 + 1)) \
        .withColumn("missing", F.col("part") - F.sum("low").over(Window.partitionBy("shard")))
    place = Window.partitionBy("shard").orderBy(F.desc("quotient"), "number", "k")
    won = by_shard.where("high > low").withColumn("k", F.explode(F.expr("sequence(low, high - 1)"))) \
        .withColumn("quotient", F.col("seats") / (2 * F.col("k") + 1)) \
        .withColumn("rank", F.row_number().over(place)).where("rank <= missing") \
        .groupBy("shard", "number").agg(F.count(F.lit(1)).alias("more"))
    ends = by_shard.join(won, ["shard", "number"], "left") \
        .groupBy("number").agg(F.array_sort(F.collect_list(F.struct(  # one entry a shard
            "shard", (F.col("low") + F.coalesce("more", F.lit(0))).alias("end")))).alias("by")) \
        .select("number", F.transform("by", lambda v: v["end"]).alias("ends"))
    n = F.greatest("n_blocks", F.lit(1))
    offset = F.conv(F.substring(seeded(seed, F.lit("offset"), F.col("source")), 1, 8), 16, 10).cast("long")
    stride = F.coalesce(*[F.when(F.col("n_blocks") % p != 0, F.lit(p)) for p in STRIDES], F.lit(1))
    return known.join(ends, "number").select(
        *goals.columns, "n_blocks", F.expr("source_size div greatest(n_blocks, 1)").alias("words"),
        F.pmod("source_size", n).alias("longer"), F.pmod(offset, n).alias("offset"),
        F.pmod(stride.cast("long"), n).alias("stride"), "ends")


def _written(df: DataFrame, label: str) -> DataFrame:
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def mix_sources(spark: SparkSession, docs: DataFrame, weights: Sequence[int] = WEIGHTS, share_halves: int = SHARE_HALVES,
                most: int = MOST, block: int = BLOCK, shards: int = SHARDS, seed: int = 0, cell_rows: int = CELL_ROWS,
                carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: ``doc_id, source``, ``carry`` columns, ``size, source_size, target, taken`` and ``spans``:
    what the mix takes of it, as (shard, copy, first word, number of words), words from 0."""
    made = ("doc_id", "source", "size", "source_size", "target", "taken", "spans")
    carry = [c for c in carry if c.lower() not in made]
    narrow = _written(docs.select("doc_id", "source", *carry, size_of().alias("size"),
                                  seeded(seed, F.col("doc_id").cast("string"), F.col("text")).alias("__key")), "mix-sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    sources = _written(quotas(targets(_written(sizes, "mix-sources"), weights, share_halves, most), block, shards, most, seed)
                       .withColumn("n_cells", F.ceil(F.col("n_rows") / F.lit(float(cell_rows)))), "mix-quotas") \
        .withColumnRenamed("source", "__s")
    # the join is on a number from here on, so that windows and joins share one exchange
    rows = narrow.join(sources, F.col("source").eqNullSafe(F.col("__s"))).drop("__s") \
        .withColumn("__cell", F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * F.col("n_cells") / F.lit(float(1 << 32))))
    cells = rows.groupBy("number", "__cell").agg(F.sum("size").alias("__n"))
    order = Window.partitionBy("number").orderBy("__cell")  # a source's rows / cell_rows
    bases = cells.select("number", "__cell", (F.sum("__n").over(order) - F.col("__n")).alias("__base"))
    inside = Window.partitionBy("number", "__cell").orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("__at", F.sum("size").over(inside) - F.col("size")).join(bases, ["number", "__cell"]) \
        .withColumn("__at", F.col("__at") + F.col("__base"))
    return placed.withColumn("spans", _spans(most)).select(
        "doc_id", "source", *carry, "size", "source_size", "target",
        F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["n_words"]).alias("taken"), "spans")


def _spans(most: int) -> Column:
    """The taken pieces of a document that holds the words ``__at`` to ``__at + size`` of its source.

    Of the source's n blocks the first ``source_size mod n`` hold one word more than the others. The place of block k among
    the blocks of a copy is (offset + stride * k) mod n; copies and places are taken in order until the quota is full."""
    n, start, end = F.col("n_blocks"), F.col("__at"), F.col("__at") + F.col("size")
    quota = F.element_at("ends", -1)

    def first_word(k: Column) -> Column:
        return k * F.col("words") + F.least(k, F.col("longer"))

    def block_of(word: str) -> Column:
        edge = "longer * (words + 1)"
        return F.expr(f"CASE WHEN {word} < {edge} THEN ({word}) div (words + 1) ELSE longer + ({word} - {edge}) div words END")

    def pieces(k: Column) -> Column:
        place = F.pmod(F.col("offset") + F.col("stride") * k, n)
        low, high = F.greatest(first_word(k), start), F.least(first_word(k + 1), end)

        def copy(c: Column) -> Column:
            slot = c * n + place
            return F.when(slot < quota, F.struct(
                F.size(F.filter("ends", lambda e: e <= slot)).cast("int").alias("shard"), c.cast("int").alias("copy"),
                (low - start).alias("first_word"), (high - low).alias("n_words")))
        return F.transform(F.sequence(F.lit(0), F.lit(most - 1)), copy)
    found = F.flatten(F.transform(F.sequence(block_of("__at"), block_of("(__at + size - 1)")), pieces))
    return F.when(F.col("size") > 0, F.filter(found, lambda s: s.isNotNull())).otherwise(
        F.array().cast("array<struct<shard:int,copy:int,first_word:bigint,n_words:bigint>>"))


def write_mix(mixed: DataFrame, path: str, text: str = "text") -> None:
    """The taken pieces (``mixed`` carries the texts) as Parquet, one folder a shard: ``doc_id, source, copy, text``."""
    pieces = mixed.withColumn("__words", F.regexp_extract_all(F.col(text), F.lit(WORD), 0)).withColumn("__span", F.explode("spans")) \
        .select("doc_id", "source", F.col("__span.shard").alias("shard"), F.col("__span.copy").alias("copy"),
                F.array_join(F.slice("__words", (F.col("__span.first_word") + 1).cast("int"), F.col("__span.n_words").cast("int")), " ").alias("text"))
    pieces.write.partitionBy("shard").parquet(path)
