"""Helpers shared by the operators: table access, Arrow batches, shared folder, worker-side objects."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

#: Texts are worked on in runs of at most this many bytes (or one text), which bounds a task's Python memory.
SLICE_CHARS = 2_000_000

#: Bytes that separate words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` become blanks, A-Z become a-z; UTF-8 bytes above 0x7F stay.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
              for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folded_words(text: str | None) -> list[bytes]:
    """Lower-cased words of a whole text as UTF-8; null and empty texts have none."""
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``doc_id, label, text`` of at most ``most`` labelled doc_ids, those of the smallest hash. A doc_id that many rows
    share gives one text (its least) for each label, so that the bound holds for texts too; null doc_ids give none."""
    few = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()) \
        .select("doc_id", F.col(label).cast("int").alias("label")).distinct() \
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors share; where it is unset, a temporary one on a
    local master and an error on a cluster."""
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def shared_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="ledgermatch-shared-")  # one machine: tests and trials
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


class Shipped:
    """An object sent to the workers once by broadcast and kept by each worker process across its tasks.

    Only for objects of a bounded size (models, vocabularies); ``limit`` is checked on the pickled bytes.
    """

    def __init__(self, spark: SparkSession, obj, limit: int = 64 << 20):
        blob = cloudpickle.dumps(obj)
        if len(blob) > limit:
            raise ValueError(f"object of {len(blob)} bytes is over the broadcast bound of {limit}")
        self.box = spark.sparkContext.broadcast({"blob": blob})

    def get(self):
        box = self.box.value
        if "obj" not in box:
            box["obj"] = cloudpickle.loads(box["blob"])
        return box["obj"]


class Memo(dict):
    """Results of ``make`` for short keys that come again; ``map(memo.__getitem__, keys)`` makes what is missing.

    A key is kept when it comes a second time, so that the many keys that come once do not drive out the frequent ones.
    Bounded: at most ``limit`` kept and three quarters as many fresh keys; what is full starts anew.
    """

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit
        self.fresh: dict = {}

    def __missing__(self, key):
        got = self.fresh.get(key)
        if got is None:
            got = self.make(key)
            if len(key) <= 64:
                if len(self.fresh) >= self.limit * 3 // 4:
                    self.fresh.clear()
                self.fresh[key] = got
            return got
        if len(self) >= self.limit:
            self.clear()
        self[key] = got
        return got


def slices(lengths: Sequence[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges whose lengths sum to at most ``limit`` (or hold a single item)."""
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def text_runs(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list]]:
    """Runs of a batch's rows with their texts, so that few texts at a time are Python objects."""
    texts = batch.column(column)
    for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        yield a, b, texts.slice(a, b - a).to_pylist()


def append_columns(df: DataFrame, fn: Callable[[list], list[pa.Array]], fields: Sequence[StructField],
                   carry: Sequence[str] | None = None, text: str = "text") -> DataFrame:
    """``carry`` columns of ``df`` (default: all) plus ``fields`` that ``fn`` makes of each run of whole texts.

    ``fn`` gets a list of texts (None for null) and returns one Arrow array for each field. A column of ``df`` with the
    name of a new field (in any case) is replaced by it. One pass, no shuffle.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if carry is None else carry) if c.lower() not in new]
    schema = StructType([df.schema[c] for c in kept] + list(fields))
    source = df.select(*kept, df[text].alias("__text"))

    def run(batches):
        for batch in batches:
            for a, b, texts in text_runs(batch, len(kept)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(part.columns[:-1] + fn(texts), names=schema.names)

    return source.mapInArrow(run, schema)
