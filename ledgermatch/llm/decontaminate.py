"""Benchmark decontamination by windows of normalised words.

Every item gives its windows of ``width`` consecutive words (all its words if it has fewer). Their hashes, with the
words behind them, go to the workers as a broadcast set, in blocks of bounded text size; the whole documents are scanned
once a block, and where there are several, each scan writes its hits by text and the last one joins them. A scan looks up each word in the block's vocabulary, hashes the windows that consist of known words only,
looks the hashes up and compares the words behind every hit, so equal hashes of different words never count.

Results at the edges: null and empty texts have no words and no hits and are not contaminated; null items give no
windows and a null item_id is written "null"; repeated documents are judged alike, each on its own; repeated items with
one id count as one item; extra columns are carried, those named like an output are replaced; an empty benchmark marks
nothing, an empty documents table gives no rows.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import Shipped, append_columns, folded_words, shared_path, text_runs

WIDTH = 13
BLOCK_BYTES = 4 << 20  # benchmark text in one broadcast
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_SPANS, _ITEMS, _WORDS = "__spans", "__items", "__words"


class WindowSet:
    """Windows of some items: sorted hashes and, for each, where its words and its item are."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        words, found = [], {}
        for name, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in folded_words(text)]
            size = min(width, len(own))
            for at in range(len(own) - size + 1 if own else 0):
                found.setdefault(size, []).append((len(words) + at, number[name]))
            words += own
        self.words = np.array(words, np.int64)
        self.power = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(width)], np.uint64)
        self.windows = {}
        for size, pairs in found.items():
            at, item = np.array(pairs, np.int64).T
            hashes = self.hashes(self.words, at, size)
            order = np.argsort(hashes, kind="stable")
            self.windows[size] = hashes[order], at[order], item[order]

    def hashes(self, words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in range(size):
            out += words[at + k].astype(np.uint64) * self.power[k]
            out ^= out >> np.uint64(29)
        return out

    def hits(self, words: np.ndarray):
        """(starts, size, items) of all occurrences in a row of word numbers (0: unknown or a text's end)."""
        unknown = np.concatenate([[0], np.cumsum(words == 0)])
        for size, (hashes, at, item) in self.windows.items():
            if len(words) < size:
                continue
            start = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(start):
                continue
            own = self.hashes(words, start, size)
            first, last = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            more = last > first
            start, first, last = start[more], first[more], last[more]
            while len(start):
                same = np.ones(len(start), bool)
                for k in range(size):
                    same &= words[start + k] == self.words[at[first] + k]
                yield start[same], size, item[first[same]]
                first = first + 1
                more = first < last
                start, first, last = start[more], first[more], last[more]

    def scan(self, texts: list[str | None]):
        """For each text: its number of words, its hit runs of words (start, end, ...) and the names of the items."""
        get, numbers, ends = self.vocabulary.get, [], [0]
        for t in texts:
            numbers.extend(map(get, folded_words(t), repeat(0)))
            numbers.append(0)
            ends.append(len(numbers))
        words, ends = np.array(numbers, np.int64), np.array(ends)
        change, owners = np.zeros(len(words) + 1, np.int64), []
        for start, size, item in self.hits(words):
            np.add.at(change, start, 1)
            np.add.at(change, start + size, -1)
            owners.append((np.searchsorted(ends, start, "right") - 1) * len(self.names) + item)
        spans, names = [[] for _ in texts], [[] for _ in texts]
        if owners:
            hit = (np.cumsum(change[:-1]) > 0).astype(np.int8)
            edge = np.diff(np.concatenate([[0], hit, [0]]))
            for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                k = np.searchsorted(ends, a, "right") - 1
                spans[k] += [int(a - ends[k]), int(b - ends[k])]
            for code in np.unique(np.concatenate(owners)):
                names[code // len(self.names)].append(self.names[code % len(self.names)])
        return (np.diff(ends) - 1).tolist(), spans, names


def merge_spans(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return a or b
    out: list[int] = []
    for s, e in sorted(zip((a + b)[::2], (a + b)[1::2])):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """Items in blocks of about ``block_bytes`` of text."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), "text") \
        .withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(blocks)))
    return [named.where(F.col("block") == b) for b in range(blocks)]


def _windows(spark: SparkSession, block: DataFrame, width: int) -> Shipped:
    """The window set of one block, which alone is on the driver."""
    return Shipped(spark, WindowSet([(r["name"], r["text"]) for r in block.collect()], width), 256 << 20)


def mark_hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = WIDTH,
              block_bytes: int = BLOCK_BYTES, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` plus __words (their number), __spans (hit runs as start, end, ...) and __items (names of items)."""
    carry = [c for c in (carry if carry is not None else docs.columns) if c.lower() not in (_SPANS, _ITEMS, _WORDS)]
    blocks = _blocks(benchmark, block_bytes)
    if len(blocks) > 1:
        return _mark_blocks(spark, docs, blocks, width, text, carry)
    windows = _windows(spark, blocks[0], width)

    def work(texts):
        n, s, i = windows.get().scan(texts)
        return [pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.int32())), pa.array(i, pa.list_(pa.string()))]

    fields = [StructField(_WORDS, LongType()), StructField(_SPANS, ArrayType(IntegerType())), StructField(_ITEMS, ArrayType(StringType()))]
    return append_columns(docs, work, fields, carry, text)


def _text_name(text: str) -> list:
    """128 bits that name a text."""
    return [F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit(1), text).alias("__t2")]


def _mark_blocks(spark: SparkSession, docs: DataFrame, blocks: list[DataFrame], width: int, text: str, carry: list[str]) -> DataFrame:
    """A scan for each block, which writes the hits alone, by text; then one scan that counts words, joined to them. One
    window set at a time is in memory, and no document is copied for a block."""
    path = shared_path(spark, "hits")
    for number, block in enumerate(blocks):
        windows = _windows(spark, block, width)

        def scan(batches, windows=windows):
            for batch in batches:
                for a, b, texts in text_runs(batch, 2):
                    _, spans, items = windows.get().scan(texts)
                    hit = [k for k, s in enumerate(spans) if s]
                    names = batch.slice(a, b - a).take(pa.array(hit, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [names.column(0), names.column(1), pa.array([spans[k] for k in hit], pa.list_(pa.int32())),
                         pa.array([items[k] for k in hit], pa.list_(pa.string()))], names=["__t1", "__t2", "s", "i"])

        docs.select(*_text_name(text), text).mapInArrow(scan, "__t1 long, __t2 long, s array<int>, i array<string>") \
            .dropDuplicates(["__t1", "__t2"]).write.parquet(f"{path}/block={number}")
        windows.box.destroy()
    merged = StructType([StructField("__t1", LongType()), StructField("__t2", LongType()),
                         StructField(_SPANS, ArrayType(IntegerType())), StructField(_ITEMS, ArrayType(StringType()))])

    def merge(batches):  # a row a text, with a list of each block's spans
        for batch in batches:
            spans = [reduce(merge_spans, s) for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int32())), batch.column(3)],
                                             names=merged.names)

    hits = spark.read.parquet(path).groupBy("__t1", "__t2").agg(  # a row a block
        F.collect_list("s").alias("s"), F.array_distinct(F.flatten(F.collect_list("i"))).alias("i")).mapInArrow(merge, merged)

    def count(texts):
        return [pa.array([len(folded_words(t)) for t in texts], pa.int64())]

    named = docs.select(*carry, *([] if text in carry else [text]), *_text_name(text))
    counted = append_columns(named, count, [StructField(_WORDS, LongType())], [*carry, "__t1", "__t2"], text)
    return counted.join(hits, ["__t1", "__t2"], "left").select(
        *carry, _WORDS, F.coalesce(_SPANS, F.array().cast("array<int>")).alias(_SPANS),
        F.coalesce(_ITEMS, F.array().cast("array<string>")).alias(_ITEMS))


def _hit_words():
    ends = F.transform(F.sequence(F.lit(1), F.size(_SPANS)), lambda k: F.when(
        k % 2 == 0, F.element_at(_SPANS, k)).otherwise(-F.element_at(_SPANS, k)))
    return F.when(F.size(_SPANS) == 0, F.lit(0)).otherwise(F.aggregate(ends, F.lit(0), lambda a, x: a + x)).cast("long")


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None,
                  least: float = 0.05, **options) -> DataFrame:
    """One row per document: ``n_words, n_hit, n_items, items, contaminated`` (hits reach the share ``least``)."""
    names = ("n_words", "n_hit", "n_items", "items", "contaminated")
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in names]
    marked = mark_hits(spark, docs, benchmark, carry=carry, **options)
    inverse = round(1 / least)
    return marked.select(*carry, F.col(_WORDS).alias("n_words"), _hit_words().alias("n_hit"),
                         F.size(_ITEMS).cast("long").alias("n_items"), F.array_sort(_ITEMS).alias("items")) \
        .withColumn("contaminated", (F.col("n_hit") > 0) & (inverse * F.col("n_hit") >= F.col("n_words")))


def remove_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least: float = 0.05,
                     **options) -> DataFrame:
    """``docs`` without the contaminated ones, all columns kept."""
    marked, inverse = mark_hits(spark, docs, benchmark, **options), round(1 / least)
    n_hit = _hit_words()
    return marked.where(~((n_hit > 0) & (inverse * n_hit >= F.col(_WORDS)))).select(*docs.columns)


def cut_spans(text: str, spans: list[int]) -> str:
    """The text without the characters from the first to the last word of each run."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return "".join(out) + text[at:]


def remove_spans(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with every hit run of words cut out of its text."""
    marked = mark_hits(spark, docs, benchmark, **options)
    schema = docs.schema

    def run(batches):
        names = [f.name for f in schema]
        at = names.index("text")
        for batch in batches:
            texts, spans = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            cut = pa.array([cut_spans(t, s) if s else t for t, s in zip(texts, spans)], pa.string())
            yield pa.RecordBatch.from_arrays([cut if k == at else batch.column(k) for k in range(len(names))], names=names)

    return marked.select(*docs.columns, _SPANS).mapInArrow(run, schema)


def items_digest(items: str = "items"):
    """SHA-256 of the sorted item names, comma-joined."""
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)
