"""Quality classifier: similarity-weighted vote of the nearest labelled documents in a latent semantic space.

A document is a bag of terms over its whole text: its words with letters folded to their shape (case, letters, digits,
marks), pairs of neighbouring shapes, marks for words that repeat their left neighbour and lines or 4-word runs that
stood before in the text, and the words themselves (A-Z folded, marks as blanks), with the character trigrams of those
over LONG bytes, such as text without blanks. For shapes, tokens of more than PIECE bytes are cut into pieces, and shapes
of more than SHAPE characters into parts, all of which count. Terms are hashed to DIMENSIONS buckets (shapes and words
apart), weighed by log frequency (words by WORD_WEIGHT besides) and inverse document frequency, and projected on the
leading singular vectors of the labelled documents' matrix. The labelled vectors are broadcast (at most MAX_LABELLED by
RANK numbers, checked); every document's cosine products with all of them are computed exactly, in blocks, and its K
nearest neighbours vote with weights that grow with the similarity.

Learning sees at most MAX_LABELLED labelled texts of the training fold (smallest hash of doc_id, one text for each doc_id
and label); every whole text is scored by its text alone. The driver holds their matrix once, as 32-bit floats (74 MB at
6,000 rows), and finds the projection by subspace iteration.

Results at the edges: null and empty texts have no terms, hence similarity 0 to all, and get the share of good labels;
without labelled rows every score is 0.5; neighbours equally near to the K-th share the places left; repeated
documents score alike; a null doc_id is held out; extra columns are carried, those named like an output are replaced; empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField

from .common import Memo, Shipped, append_columns, folded_words, labelled_texts, text_runs

MAX_LABELLED = 6_000
SHAPE_BUCKETS, WORD_BUCKETS = 2048, 1024
DIMENSIONS = SHAPE_BUCKETS + WORD_BUCKETS
WORD_WEIGHT = 0.5
PIECE, SHAPE, LONG = 64, 12, 12
RANK = 48
K = 15
BLOCK = 256  # documents in one product
MEMO_LIMIT = 200_000
#: A-Z -> A, a-z and all bytes above 0x7F -> a, 0-9 -> 9; other bytes stay.
_SHAPE = bytes(0x41 if 0x41 <= c <= 0x5A else 0x39 if 0x30 <= c <= 0x39 else 0x61 if 0x61 <= c <= 0x7A or c >= 0x80 else c
               for c in range(256))
_RUN = re.compile(rb"(.)\1{2,}", re.DOTALL)


def _bucket(term: bytes) -> int:
    return zlib.crc32(term) % SHAPE_BUCKETS


def _shapes(word: bytes) -> list[bytes]:
    """The shape with runs of one character cut to two, in parts of SHAPE characters."""
    shape = _RUN.sub(rb"\1\1", word.translate(_SHAPE))
    return [shape[k:k + SHAPE] for k in range(0, len(shape), SHAPE)]


def _word_bucket(word: bytes) -> int:
    return zlib.crc32(b"w" + word) % WORD_BUCKETS


def _trigrams(words: bytes) -> np.ndarray:
    """Buckets of all runs of three characters."""
    c = np.frombuffer(words.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    mixed = (c[:-2] << np.uint64(42)) ^ (c[1:-1] << np.uint64(21)) ^ c[2:]
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS


class Terms:
    """Term buckets of a text; a worker keeps the shapes of frequent words."""

    def __init__(self):
        self.shapes: dict[bytes, int] = {}  # word -> number of its shape, or -1 - its place in parts
        self.parts: list[list[int]] = []  # numbers of shapes of more than one part
        self.words = Memo(_word_bucket, MEMO_LIMIT)
        self.numbers: dict[bytes, int] = {}
        self.single: list[int] = []  # bucket of each shape
        self.pairs: dict[int, int] = {}

    def __getstate__(self):
        return {}

    def __setstate__(self, _):
        self.__init__()

    def _number(self, word: bytes) -> int:
        own = []
        for shape in _shapes(word):
            if shape not in self.numbers:
                self.numbers[shape] = len(self.single)
                self.single.append(_bucket(b"s" + shape))
            own.append(self.numbers[shape])
        if len(self.shapes) >= MEMO_LIMIT:
            self.shapes.clear()
        if len(own) > 1:
            self.parts.append(own)
            own = [-len(self.parts)]
        got = self.shapes[word] = own[0]
        return got

    def _word_counts(self, text: str) -> np.ndarray:
        words = folded_words(text)
        out = np.bincount(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)), minlength=WORD_BUCKETS)
        long = b" ".join(w for w in words if len(w) > LONG)
        return out + np.bincount(_trigrams(long), minlength=WORD_BUCKETS) if long else out

    def counts(self, text: str | None) -> dict[int, float]:
        """Bucket -> weight log(1 + times)."""
        if not text:
            return {}
        data = text.encode("utf-8", "replace")
        words = data.split()
        if not words:
            return {}
        if max(map(len, words)) > PIECE:
            words = [w[k:k + PIECE] for w in words for k in range(0, len(w), PIECE)]
        if len(self.numbers) > MEMO_LIMIT or len(self.parts) > MEMO_LIMIT:
            self.__init__()
        shapes = list(map(self.shapes.get, words))
        if None in shapes:
            for k, s in enumerate(shapes):
                if s is None:
                    shapes[k] = self.shapes.get(words[k])
                    if shapes[k] is None:
                        shapes[k] = self._number(words[k])
        own = np.array(shapes, np.int64)
        if (own < 0).any():
            own = np.array([n for s in shapes for n in ((s,) if s >= 0 else self.parts[-s - 1])], np.int64)
        hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        out: Counter = Counter()
        values, n = np.unique(own, return_counts=True)
        for v, c in zip(values.tolist(), n.tolist()):
            out[self.single[v]] += c
        values, n = np.unique(own[:-1] << 32 | own[1:], return_counts=True)
        for v, c in zip(values.tolist(), n.tolist()):
            b = self.pairs.get(v)
            if b is None:
                if len(self.pairs) >= MEMO_LIMIT:
                    self.pairs.clear()
                b = self.pairs[v] = _bucket(b"p%d,%d" % (self.single[v >> 32], self.single[v & 0xFFFFFFFF]))
            out[b] += c
        size = len(words)
        same = int((hashes[1:] == hashes[:-1]).sum())
        runs = 0
        if size >= 8:
            mixed = hashes[:-3] * np.uint64(0x9E3779B97F4A7C15)
            for k in (1, 2, 3):
                mixed = (mixed ^ hashes[k:size - 3 + k]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
            runs = len(mixed) - len(np.unique(mixed))
        lines = data.split(b"\n")
        for name, part, whole in ((b"same", same, size), (b"runs", runs, size), (b"lines", len(lines) - len(set(lines)), len(lines)),
                                  (b"few", size - len(set(words)), size)):
            level = int(10 * part / whole)  # how large a part, in tenths
            for k in range(level):
                out[_bucket(b"r" + name + b"%d" % k)] += max(4, size // 4)
        weights = {b: float(np.log1p(c)) for b, c in out.items()}
        n = self._word_counts(text)
        at = n.nonzero()[0]
        weights.update(zip((at + SHAPE_BUCKETS).tolist(), (WORD_WEIGHT * np.log1p(n[at])).tolist()))
        return weights


class Bags(NamedTuple):
    """Bags of terms as sparse rows: row k holds buckets and weights ``ends[k]`` to ``ends[k + 1]``."""

    ends: np.ndarray
    buckets: np.ndarray
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.ends) - 1


def _matrix(rows: list[dict[int, float]] | Bags) -> np.ndarray:
    out = np.zeros((len(rows), DIMENSIONS), np.float32)
    if isinstance(rows, Bags):
        out[np.repeat(np.arange(len(rows)), np.diff(rows.ends)), rows.buckets] = rows.weights
        return out
    for k, row in enumerate(rows):
        if row:
            out[k, list(row)] = list(row.values())
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _leading(x: np.ndarray, rank: int, rounds: int = 12, more: int = 16) -> np.ndarray:
    """The ``rank`` leading right singular vectors of ``x`` by subspace iteration: products with ``x`` alone, so that no
    square matrix of its dimensions is held."""
    size = min(rank + more, *x.shape)
    span = np.random.default_rng(5).standard_normal((x.shape[1], size)).astype(np.float32)
    for _ in range(rounds):
        span = np.linalg.qr(x.T @ (x @ span))[0].astype(np.float32)
    small = (x @ span).astype(np.float64)
    _, turn = np.linalg.eigh(small.T @ small)
    top = (span @ turn[:, ::-1][:, :rank]).astype(np.float32)
    return top * np.sign(top[np.abs(top).argmax(0), np.arange(top.shape[1])])


class NeighbourModel:
    """Inverse document frequencies, projection, and the labelled latent vectors."""

    def __init__(self, rows: list[dict[int, float]] | Bags, labels: list[int]):
        self.terms, self.labels = Terms(), np.array(labels, np.float32)
        self.prior = float(self.labels.mean()) if len(labels) else 0.5
        if not len(labels):
            return
        x = _matrix(rows)
        self.idf = (np.log((1 + len(rows)) / (1 + (x > 0).sum(0))) + 0.1).astype(np.float32)
        x *= self.idf
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        np.divide(x, norm, out=x, where=norm > 0)
        self.projection = _leading(x, RANK)
        self.vectors = _unit(x @ self.projection)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out = np.empty(len(texts))
        for at in range(0, len(texts), BLOCK):
            rows = _matrix([self.terms.counts(t) for t in texts[at:at + BLOCK]])
            near = _unit(_unit(rows * self.idf) @ self.projection) @ self.vectors.T
            near = np.round(np.maximum(near, 0), 5)
            k = min(K, near.shape[1])
            last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k][:, None]
            above, equal = near > last, near == last  # equals share the places left
            share = (k - above.sum(1)) / equal.sum(1)
            weight = (near ** 8 + 1e-6) * (above + equal * share[:, None])  # near neighbours outvote far ones
            out[at:at + BLOCK] = np.where(near.max(1) > 0, weight @ self.labels / weight.sum(1), self.prior)
        return out


def training_fold(fold: int = 3):
    """Rows that the model may learn from; a null doc_id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) != 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED) -> NeighbourModel:
    """The model from at most ``most`` labelled training texts; their bags of terms go to the driver as Arrow columns."""
    chosen = labelled_texts(docs, labels.where(training_fold()), label, most)

    def run(batches):
        terms = Terms()
        for batch in batches:
            for a, b, texts in text_runs(batch, 2):
                rows = [terms.counts(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     pa.array([list(r) for r in rows], pa.list_(pa.int32())),
                     pa.array([list(r.values()) for r in rows], pa.list_(pa.float32()))], names=["doc_id", "label", "b", "w"])

    rows = chosen.mapInArrow(run, "doc_id long, label int, b array<int>, w array<float>").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending")]).combine_chunks()
    if not rows.num_rows:
        return NeighbourModel([], [])
    buckets, weights = (rows.column(c).chunk(0) for c in ("b", "w"))
    bags = Bags(buckets.offsets.to_numpy() - buckets.offsets[0].as_py(), buckets.flatten().to_numpy(),
                weights.flatten().to_numpy())
    return NeighbourModel(bags, rows.column("label").to_numpy())


def score_quality(spark: SparkSession, docs: DataFrame, model: NeighbourModel, carry: list[str] | None = None) -> DataFrame:
    """``score`` (0 to 1, higher: better) and ``predicted`` (score >= 0.5) of every whole text."""
    shipped = Shipped(spark, model, 32 << 20)

    def work(texts):
        scores = shipped.get().scores(texts)
        return [pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())]

    return append_columns(docs, work, [StructField("score", DoubleType()), StructField("predicted", IntegerType())], carry)


def keep_good(spark: SparkSession, docs: DataFrame, model: NeighbourModel) -> DataFrame:
    """``docs``, all columns, without the documents that the model rejects."""
    shipped = Shipped(spark, model, 32 << 20)

    def work(texts):
        return [pa.array(shipped.get().scores(texts) >= 0.5)]

    return append_columns(docs, work, [StructField("__keep", BooleanType())]).where("__keep").select(*docs.columns)
