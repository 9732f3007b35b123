"""Token ids as Parquet list columns, written in ascending document order and read selectively.

Each file holds a contiguous range of doc_id: ``doc_id, n_tokens, part, offset, input_ids``. ``input_ids`` is a list of
32-bit integers, dictionary-coded per row group (delta-coded where a dictionary would not pay), ``part`` and ``offset``
place a document in the whole stream: its file's number and the ids before it in that file. Row groups and pages have
set sizes and every page has an index entry, so a reader that asks for some doc_ids, or only for the metadata columns,
touches those pages alone.

The ids come from the tokenizers library. A text is cut where its pre-tokenizer always cuts, before white space that
follows something else; equal cuts have equal ids, so each worker keeps those of the last few hundred thousand cuts.
Texts that hold a special token's string go to the library whole.

Results at the edges: null and empty texts are written with the end id alone; null doc_ids come first; rows with equal
doc_ids lie in text order and are all written; extra input columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import Memo, Shipped, text_runs

#: Unicode White_Space, as the library's pre-tokenizer sees it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White space other than blanks and line breaks, and both of these side by side.
RARE = "\0\t\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TWICE = ("  ", "\n\n", " \n", "\n ")
PLAIN = re.compile(r"(\n)?( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
MEMO_LIMIT = 400_000  # cuts that a worker keeps, see Memo
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 128 << 10
SAMPLED_IDS = 100  # ids that the edges of one range are chosen from


class CutEncoder:
    """Byte-level BPE ids by cuts. Pickles as the tokenizer file's text."""

    def __init__(self, spec: str):
        import json

        from tokenizers import Tokenizer
        self.spec = spec
        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        known = json.loads(spec)
        pre = known.get("pre_tokenizer") or {}
        #: whether the file's rules cut before white space: the byte-level pattern and no normaliser before it
        self.cuts = not known.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) \
            and not pre.get("add_prefix_space") and not known.get("truncation") and not known.get("padding")
        self.special = [t["content"] for t in known.get("added_tokens", [])]
        self.runs = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.memo, self.marks = Memo(self.cut_ids, MEMO_LIMIT), {}
        #: what stands in the vocabulary for the bytes of a blank and of the letters of PLAIN beyond ASCII
        bare = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = dict(zip([b for b in range(256) if b not in bare], map(chr, range(256, 512))))
        self.shown = {c: "".join(letters.get(b, chr(b)) for b in c.encode()) for c in [" ", *map(chr, range(0xC0, 0x100))]}

    def __reduce__(self):
        return CutEncoder, (self.spec,)

    def cut(self, text: str) -> list[str]:
        """Cuts that tokenise alone as they do in the text."""
        if any(c in text for c in RARE) or any(c in text for c in TWICE) or text[0] in " \n" or text[-1] in " \n":
            return self.runs.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")  # single blanks and line breaks only

    def cut_ids(self, cut: str) -> bytes:
        """Ids of one cut as little-endian 32-bit integers."""
        if cut.isascii() and cut[1:].isalpha() and (cut[0] == " " or cut[0].isalpha()):
            return self.merged(cut.replace(" ", "\u0120"))
        plain = PLAIN.fullmatch(cut)
        if plain is None:
            return self.ids(cut)
        line, word, marks = plain.groups()  # pre-tokens that need no general pattern: a line break, a word, marks
        if not line and not marks:
            return self.merged("".join(map(self.shown.get, word, word)))
        got = self.memo[word]  # the word alone is often known
        if marks:
            got += self.signs(marks)
        return self.signs(line) + got if line else got

    def signs(self, text: str) -> bytes:
        """Ids of a line break or of marks; a few thousand short ones are kept."""
        got = self.marks.get(text)
        if got is None:
            got = self.merged(text.replace("\n", "\u010a"))
            if len(text) <= 4 and len(self.marks) < 4000:
                self.marks[text] = got
        return got

    def merged(self, shown: str) -> bytes:
        """Ids of one pre-token, in the letters that stand for its bytes, by the library's merge model."""
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        if not text:
            return b""
        if not self.cuts or any(s in text for s in self.special):
            return self.ids(text)
        return b"".join(map(self.memo.__getitem__, self.cut(text)))


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer_path: str, path: str, end_id: int | None = None,
                 partitions: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES,
                 text: str = "text") -> None:
    """Encode ``doc_id`` and ``text`` of ``docs`` and write them to ``path`` in ascending doc_id order.

    One shuffle, by ranges of doc_id; a doc_id that many rows share is split by a checksum of the text.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = Shipped(spark, CutEncoder(f.read()))
    tail = array("I", [] if end_id is None else [end_id]).tobytes()
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("n_tokens", LongType()),
                         StructField("part", IntegerType()), StructField("offset", LongType()),
                         StructField("input_ids", ArrayType(IntegerType(), False))])

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, texts in text_runs(batch, 1):
                rows = [ids + tail for ids in map(shipped.get().encode, texts)]
                sizes = [len(r) // 4 for r in rows]
                ends = [0]
                for n in sizes:
                    ends.append(ends[-1] + n)
                values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(rows))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array([part] * len(sizes), pa.int32()),
                     pa.array([before + e for e in ends[:-1]], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=schema.names)
                before += ends[-1]

    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, crc = places(docs, parts, F.col("__text"))
    rows = docs.select("doc_id", F.col(text).alias("__text")).select("doc_id", "__text", part.alias("__part"), crc.alias("__crc"))
    (rows.repartitionById(parts, "__part").sortWithinPartitions("doc_id", "__crc", "__text").select("doc_id", "__text")
     .mapInArrow(run, schema).write
     .option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "true")
     .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
     .option("compression", "zstd").parquet(path))


def places(docs: DataFrame, parts: int, text: Column) -> tuple[Column, Column]:
    """The range of doc_id (0 to ``parts`` - 1, null first) that a row belongs to, and what orders rows of one doc_id.

    The edges come from a sample of about SAMPLED_IDS ids a range, read from that column alone. A doc_id that several
    edges name is split over their ranges by the checksum of its texts; other rows need none (null).
    """
    share = min(1.0, SAMPLED_IDS * parts / max(docs.count(), 1))
    ids = sorted((r[0] for r in docs.select("doc_id").sample(share, seed=7).collect()), key=lambda v: (v is not None, v))
    edges = [ids[len(ids) * k // parts] for k in range(1, parts)] if ids else []
    missing = edges.count(None)
    known, doc_id = edges[missing:], F.col("doc_id")
    table = F.array(*map(F.lit, known)).cast(ArrayType(docs.schema["doc_id"].dataType))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(len(known), 1).bit_length()))])

    def edges_while(holds):  # binary search: how many edges of the sorted table hold
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
            (at + step <= len(known)) & holds(F.get(table, at + step - 1)), at + step).otherwise(at))

    below = F.when(doc_id.isNull(), 0).otherwise(missing + edges_while(lambda edge: edge < doc_id))
    width = F.when(doc_id.isNull(), missing).otherwise(missing + edges_while(lambda edge: edge <= doc_id) - below)
    crc = F.when(width > 1, F.coalesce(F.crc32(text.cast("binary")), F.lit(0)))
    return (below + F.coalesce(F.floor(crc * width / F.lit(float(1 << 32))), F.lit(0))).cast("int"), crc


def read_tokens(spark: SparkSession, path: str, doc_ids: tuple[int, int] | None = None) -> DataFrame:
    """Documents of the store; ``doc_ids``: a closed range, which reaches the files as a pushed filter."""
    stored = spark.read.parquet(path)
    return stored if doc_ids is None else stored.where(F.col("doc_id").between(*doc_ids))


def token_starts(spark: SparkSession, path: str) -> DataFrame:
    """For each file (``part``) the ids in all files before it, from the metadata columns alone; one row a file."""
    sums = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    return sums.select("part", (F.sum("__n").over(Window.orderBy("part")) - F.col("__n")).alias("base"))


def digest_tokens(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold, by document: ``doc_id, start, n_tokens, ids_crc32``."""
    schema = StructType([StructField("doc_id", spark.read.parquet(path).schema["doc_id"].dataType),
                         StructField("part", IntegerType()), StructField("offset", LongType()),
                         StructField("n_tokens", LongType()), StructField("ids_crc32", LongType())])

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            ends, data = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy().astype("<u4", copy=False))
            crc = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(ends[1:] - ends[:-1], pa.int64()),
                 pa.array(crc, pa.int64())], names=schema.names)

    read = read_tokens(spark, path).select("doc_id", "part", "offset", "input_ids").mapInArrow(run, schema)
    return read.join(token_starts(spark, path), "part").select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
