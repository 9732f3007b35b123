"""Trie of the prefixes that conversations share, with totals over subtrees by a depth-band rollup.

Conversations are sequences of turns (role, text). Every distinct sequence of a conversation's first d turns is a node of
depth d; the root is the empty sequence. A node is named by its depth and the exclusive or of 128-bit hashes of (place,
role, text) of its turns, so that a prefix's name is a running aggregate, and no two sequences that occur are told to be
one but by a collision of 128 bits.

1. Turns become narrow rows (role, digest and number of words of the text), sorted by ranges of (conversation, turn), so
   that a conversation of any length spreads over tasks; counts of the parts before give each turn its place.
2. Names are running aggregates within runs of RUN places, plus the aggregate of the runs before. Beside its own name
   each row keeps the names of the ancestors in its band: ``height`` depths that start at a multiple of ``height``. The
   first node of a band keeps those of the whole band above.
3. Nodes are one aggregation of these rows (members, the smallest member, its ancestors).
4. Every node adds its own figures to its ancestors within its band alone, so that a node makes at most ``height`` rows
   whatever the depth. That completes all bands but for what lies below them. The first nodes of the bands then add up
   along the chain of bands, with pointers that double each round: after log2(depth / height) rounds their totals are
   complete. Each completed total goes to the ancestors in the band above, which completes every node.

Hot prefixes (a first turn that a third of all conversations share) meet in partial aggregations only, and in joins of
written tables, which adaptive execution splits. The conversations that end in a node are joined to text in runs of END_RUN
ids; one task reads a node's runs in order and hashes them as a stream, never holding them together.

Results at the edges: a null role or text is an empty one; turns stand in the order of turn (null first), then role, then
the digest of the text, so that repeated rows are turns of their own; rows with a null conversation id belong to no
conversation and are left out; conversations without turns are members of the root alone; other columns are ignored; an
empty table has no node.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import shared_path, slices

HEIGHT = 16
RUN = 4096  # places in one run of running aggregates; a multiple of every height
END_RUN = 256  # conversation ids (neighbours by number) in one piece of text
NAME = ["depth", "x1", "x2"]
WORD = "[^\\x20\\x09-\\x0D]+"


def _written(df: DataFrame, label: str) -> DataFrame:
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def placed_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place`` (from 1), ``role, digest, words`` of every turn."""
    turns = _written(conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("words")), "trie-turns")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    kept = _written(turns.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("part", F.spark_partition_id()), "trie-sorted")
    inside = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    parts = kept.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = parts.withColumn("base", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n"))  # a row a part
    return kept.withColumn("place", F.row_number().over(inside)).join(before.drop("n"), ["conv_id", "part"]) \
        .select("conv_id", (F.col("place") + F.col("base")).cast("long").alias("place"), "role", "digest", "words")


def rebuilt(conversations: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that take their first turns from another one, as samples of one prompt do.

    Conversation c takes the first h = crc32(decimal c) mod ``heads`` turns of c - c mod ``every`` instead of its own.
    Returns the turns (``conv_id, depth, role, digest, words``) and the conversations (``conv_id, length``).
    """
    turns = _written(placed_turns(conversations), "trie-places")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    known = turns.groupBy("conv_id").agg(F.max("place").alias("n")).withColumn("h", h) \
        .withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    first = turns.where((F.col("place") < heads) & (F.col("conv_id") % every == 0)).groupBy(F.col("conv_id").alias("base")) \
        .agg(F.array_sort(F.collect_list(F.struct("place", "role", "digest", "words"))).alias("first"))  # under ``heads`` turns
    convs = _written(known.join(first, "base", "left").withColumn("first", F.filter("first", lambda t: t["place"] <= F.col("h")))
                     .withColumn("taken", F.coalesce(F.size("first"), F.lit(0)))
                     .select("conv_id", "h", "first", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")),
                     "trie-convs")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place > h") \
        .select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "role", "digest", "words")
    head = convs.select("conv_id", F.explode("first").alias("t")).select("conv_id", F.col("t.place").alias("depth"), "t.role", "t.digest", "t.words")
    return own.union(head), convs.select("conv_id", "length")


def _runs(turns: DataFrame) -> DataFrame:
    """``turns`` with the names ``x1, x2`` of their prefixes and ``run``."""
    z = turns.withColumn("run", F.expr(f"(depth - 1) div {RUN}")) \
        .withColumn("z1", F.xxhash64(F.lit(1), "depth", "role", "digest")).withColumn("z2", F.xxhash64("digest", "role", "depth", F.lit(2)))
    z = _written(z.drop("role", "digest"), "trie-hashes")
    sums = z.groupBy("conv_id", "run").agg(F.bit_xor("z1").alias("r1"), F.bit_xor("z2").alias("r2"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row a run
    bases = sums.select("conv_id", "run", *[F.coalesce(F.bit_xor(f"r{k}").over(before), F.lit(0)).alias(f"b{k}") for k in (1, 2)])
    up_to = Window.partitionBy("conv_id", "run").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    return z.select("*", *[F.bit_xor(f"z{k}").over(up_to).alias(f"x{k}") for k in (1, 2)]).join(bases, ["conv_id", "run"]) \
        .select("conv_id", "depth", "words", "run", "b1", "b2", *[F.col(f"x{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"x{k}") for k in (1, 2)])


def nodes_of(turns: DataFrame, convs: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, ``conv_id, n_convs, words, up``: names of the ancestors by rising depth) and ends (name, ``conv_id``)."""
    last = Window.partitionBy("conv_id", "run").orderBy("depth").rowsBetween(-height, -1)
    name = F.struct("x1", "x2")
    # 0 < depth mod height: the ancestors in the band; 0: all of the band above
    above = F.when(F.col("depth") % height == 0, height).otherwise(F.col("depth") % height).cast("int")
    start = F.array(F.struct(F.col("b1").alias("x1"), F.col("b2").alias("x2")))  # where the run starts
    rows = _runs(turns).withColumn("up", F.collect_list(name).over(last)) \
        .withColumn("up", F.slice(F.concat(start, "up"), -above, above))
    rows = _written(rows.drop("run", "b1", "b2"), "trie-rows")
    found = rows.groupBy(*NAME).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                    F.max("words").alias("words"), F.min_by("up", "conv_id").alias("up"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0") \
        .select(*[F.lit(0).cast("long").alias(c) for c in NAME], "conv_id", "n_convs", F.lit(0).cast("long").alias("words"),
                F.array().cast("array<struct<x1:bigint,x2:bigint>>").alias("up"))
    ends = rows.join(convs.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select(*NAME, "conv_id") \
        .union(convs.where("length = 0").select(*[F.lit(0).cast("long").alias(c) for c in NAME], "conv_id"))
    return _written(found.union(root), "trie-nodes"), ends


def _parent() -> list[Column]:
    return [(F.col("depth") - 1).alias("depth"), F.try_element_at("up", F.lit(-1))["x1"].alias("x1"), F.try_element_at("up", F.lit(-1))["x2"].alias("x2")]


def _to_ancestors(rows: DataFrame, measures: list[str], own: bool) -> DataFrame:
    """A row for each ancestor in ``up`` (and for the node itself)."""
    up = F.transform("up", lambda u, k: F.struct((F.col("depth") - F.size("up") + k).cast("long").alias("depth"), u["x1"].alias("x1"), u["x2"].alias("x2")))
    if own:
        up = F.concat(F.when(F.col("banded"), up).otherwise(F.slice(up, 1, 0)), F.array(F.struct(*NAME)))
    return rows.select(F.explode(up).alias("to"), *measures).select("to.*", *measures)


def rollup(nodes: DataFrame, measures: list[str], height: int = HEIGHT) -> DataFrame:
    """Name and sums of ``measures`` over each node's subtree (the node included), by bands of ``height`` depths."""
    sums = [F.sum(m).alias(m) for m in measures]
    nodes = nodes.withColumn("banded", F.col("depth") % height > 0)
    inside = _written(_to_ancestors(nodes, measures, own=True).groupBy(*NAME).agg(*sums), "trie-inside")
    # the first node of each band, with the band's first node above it
    tops = nodes.where(~F.col("banded")).select(*NAME, "up").join(inside, NAME)
    chain = _written(tops.select(*NAME, (F.col("depth") - height).alias("to"), F.get("up", F.lit(0))["x1"].alias("t1"),
                                 F.get("up", F.lit(0))["x2"].alias("t2"), *measures).withColumn("to", F.when(F.col("to") >= 0, F.col("to"))), "trie-chain")
    while chain.where("to IS NOT NULL").limit(1).count():
        to = [F.col("to").alias("depth"), F.col("t1").alias("x1"), F.col("t2").alias("x2")]
        gain = chain.where("to IS NOT NULL").groupBy(*to).agg(*[F.sum(m).alias("g_" + m) for m in measures])
        grown = chain.join(gain, NAME, "left").select(
            *NAME, "to", "t1", "t2", *[(F.col(m) + F.coalesce("g_" + m, F.lit(0))).alias(m) for m in measures])
        grown = _written(grown, "trie-chain")
        far = chain.select(F.col("depth").alias("to"), F.col("x1").alias("t1"), F.col("x2").alias("t2"),
                           F.col("to").alias("to2"), F.col("t1").alias("s1"), F.col("t2").alias("s2"))
        chain = _written(grown.join(far, ["to", "t1", "t2"], "left").select(
            *NAME, F.col("to2").alias("to"), F.col("s1").alias("t1"), F.col("s2").alias("t2"), *measures), "trie-chain")
    below = chain.where("depth > 0").join(nodes.select(*NAME, "up"), NAME)
    return inside.union(_to_ancestors(below, measures, own=False).select(inside.columns)).groupBy(*NAME).agg(*sums)


def end_digests(ends: DataFrame) -> DataFrame:
    """Name and ``ends_sha256`` of each node that conversations end in: their ids, ascending and comma-joined."""
    pieces = ends.groupBy(*NAME, F.floor(F.col("conv_id") / F.lit(float(END_RUN))).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"),
        F.min("conv_id").alias("first"))  # END_RUN ids at most
    ordered = pieces.repartition(*NAME).sortWithinPartitions(*NAME, "first").select(*NAME, "ids")

    def run(batches):
        name, state, done = None, None, []

        def flushed():
            columns = list(zip(*[(*n, h) for n, h in done])) or [[]] * 4
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string())],
                                             names=[*NAME, "ends_sha256"])
            done.clear()
            return out
        for batch in batches:
            sizes = [v or 0 for v in pa.compute.binary_length(batch.column(3)).to_pylist()]
            for a, b in slices(sizes):
                part = batch.slice(a, b - a)
                for *own, ids in zip(*(part.column(k).to_pylist() for k in range(4))):
                    if own == name:
                        state.update(b",")
                    else:
                        if name is not None:
                            done.append((name, state.hexdigest()))
                        name, state = own, hashlib.sha256()
                    state.update(ids.encode())
            if done:
                yield flushed()
        if name is not None:
            done.append((name, state.hexdigest()))
            yield flushed()

    return ordered.mapInArrow(run, "depth long, x1 long, x2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``, and the node's name ``x1, x2``.

    ``turns``: conv_id, depth (1, 2, ... without gaps), role, digest, words. ``convs``: conv_id, length (0 if turnless).
    """
    if RUN % height:
        raise ValueError(f"height must divide {RUN}")
    nodes, ends = nodes_of(turns, convs, height)
    children = nodes.where("depth > 0").groupBy(*_parent()).agg(F.count(F.lit(1)).alias("n_children"))
    own = _written(nodes.join(children, NAME, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
                   .withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
                   .withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")), "trie-own")
    totals = rollup(own, ["n_leaves", "saved_tokens"], height)
    whole = reduce(lambda df, more: df.join(more, NAME, "left"), (totals, end_digests(ends)),
                   own.select(*NAME, "conv_id", "n_convs", "n_children", "up"))
    named = whole.select("*", *[c.alias(n) for c, n in zip(_parent(), ("p0", "p1", "p2"))])
    parents = nodes.select(F.col("depth").alias("p0"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return named.join(parents, ["p0", "p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "x1", "x2")
