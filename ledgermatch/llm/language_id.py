"""Language identification by bit-sliced Bloom filters of byte n-grams.

For each language every n-gram of its training texts enters a Bloom filter. The filters are stored bit-sliced: position p
holds a bit mask of the languages whose filter has bit p set, so that the AND of an n-gram's few positions gives all
languages that contain it. All filters have one size, chosen so that the one with the most n-grams stays below
FALSE_RATE, as far as MASK_BYTES allows. A text is judged by the number of its n-grams in each language, less what the
filter's false positives add by its fill; the language with the largest corrected share wins.

The model is fitted on about MAX_PER_LANGUAGE texts of each language: training rows whose hashed doc_id lies in the share
of the hash range that holds so many of the language's rows, one text for each doc_id. N-grams become positions and
positions masks within Spark; only the masks (MASK_BYTES at most) and one row a language reach the driver. No language
and no n-gram is left out; more languages than MASK_BYTES can hold at the least filter size are an error. Every whole
text is judged by its text alone.

Results at the edges: null texts and texts without a letter are "und" with score 0, so is everything if no training row
has a language; a text with letters but no known n-gram gets the most frequent training language with score 0; ties go
to the more frequent, then the smaller name; a null doc_id is held out; extra columns are carried, those named like an
output are replaced.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from .common import Shipped, append_columns, shared_path, text_runs

MAX_PER_LANGUAGE = 1000
FALSE_RATE = 0.01  # of the fullest filter
MASK_BYTES = 32 << 20  # of all filters together
LEAST_BITS = 10  # of a filter's position
HASHES = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
GRAM = 4
LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed byte 4-grams of lower-cased texts, and the end of each text among them. No gram spans two texts or blanks."""
    parts = [b" " + (t or "").lower().encode("utf-8", "replace").translate(_FOLD) + b" \0\0\0" for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    if len(data) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    wide = data.astype(np.uint32)
    packed = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    blank = data == 0x20
    good = (data[:-3] != 0) & (data[3:] != 0) & ~(blank[1:-2] & (blank[:-3] | blank[2:-1])) & ~(blank[2:-1] & blank[3:])
    kept = np.concatenate([[0], np.cumsum(good)])
    return packed[good], kept[np.minimum(ends, len(good))]


def position_bits(n_grams: int, n_languages: int) -> int:
    """Bits of a position at which a filter of ``n_grams`` stays below FALSE_RATE and all filters within MASK_BYTES."""
    need = -len(HASHES) * n_grams / math.log(1 - FALSE_RATE ** (1 / len(HASHES)))
    room = MASK_BYTES // (8 * (-(-n_languages // 64) or 1))
    if room < 1 << LEAST_BITS:
        raise ValueError(f"{n_languages} languages are more than filters of {MASK_BYTES} bytes hold")
    return min(max(LEAST_BITS, math.ceil(math.log2(max(need, 1)))), room.bit_length() - 1)


class LanguageFilters:
    """``names`` by falling frequency; bit k % 64 of ``masks[k // 64, p]``: whether language k has position p."""

    def __init__(self, names: list[str], masks: np.ndarray):
        self.names, self.masks = names, masks
        self.bits = masks.shape[1].bit_length() - 1
        fill = [float(((masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) for k in range(len(names))]
        self.false = np.array([f ** len(HASHES) for f in fill])
        if len(names) <= 8:  # small masks stay in the processor's cache
            self.masks = masks.astype(np.uint8)

    def at(self, packed: np.ndarray, h: int) -> np.ndarray:
        return (packed * np.uint32(h)) >> np.uint32(32 - self.bits)

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and how many of them each language's filter holds."""
        packed, ends = grams(texts)
        found = np.zeros((len(texts), len(self.names)), np.int64)
        places = [self.at(packed, h) for h in HASHES]
        for w in range(len(self.masks)):
            hit = self.masks[w][places[0]]
            for p in places[1:]:
                hit &= self.masks[w][p]
            for k in range(w * 64, min(len(self.names), w * 64 + 64)):
                sums = np.concatenate([[0], np.cumsum((hit >> hit.dtype.type(k % 64)) & hit.dtype.type(1), dtype=np.int64)])
                found[:, k] = np.diff(np.concatenate([[0], sums[ends]]))
        return np.diff(np.concatenate([[0], ends])), found

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts)
        total, found = self.counts(texts)
        n = np.maximum(total, 1)[:, None]
        share = np.maximum(found / n - self.false, 0) / np.maximum(1 - self.false, 1e-9)
        best, sums = share.argmax(1), share.sum(1)
        names, scores = [], []
        for t, k, top, s in zip(texts, best, share.max(1), sums):
            if not t or not LETTER.search(t):
                names.append("und")
                scores.append(0.0)
            else:
                names.append(self.names[k])
                scores.append(float(top / s) if s > 0 else 0.0)
        return names, scores


def held_out(fold: int = 5) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) == 0, F.lit(True))


def _positions(packed: F.Column, bits: int) -> F.Column:
    """The positions of a packed n-gram, as ``LanguageFilters.at`` has them: products modulo 2^32, by halves."""
    low, high = packed.bitwiseAND(F.lit(0xFFFF)), F.shiftright(packed, 16)
    products = [(low * F.lit(h) + F.shiftleft((high * F.lit(h)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))
                for h in HASHES]
    return F.array(*[F.shiftright(p, 32 - bits) for p in products])


def training_texts(train: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """``lang, text`` of the rows whose hashed doc_id lies in the first ``most`` of its language's n rows' share of the
    range; one text for each doc_id. No language is gathered in one task."""
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    return train.select("lang", "doc_id", "text").join(F.broadcast(counts), "lang").where(place * F.col("n") < most) \
        .groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")


def fit(train: DataFrame, most: int = MAX_PER_LANGUAGE) -> LanguageFilters:
    """Filters from about ``most`` texts of each language of ``train``."""
    spark = train.sparkSession
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    found = train.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # one row a language
    names = [r["lang"] for r in found]
    if not names:
        return LanguageFilters([], np.zeros((1, 1 << LEAST_BITS), np.uint64))
    position_bits(0, len(names))
    counts = spark.createDataFrame([(r["lang"], r["count"], k) for k, r in enumerate(found)], "lang string, n long, k int")

    def run(batches):  # distinct packed grams, one row per language, gram and run of texts
        for batch in batches:
            for a, b, texts in text_runs(batch, 1):
                langs = batch.column(0).slice(a, b - a).to_pylist()
                for lang in sorted(set(langs)):
                    packed, _ = grams([t for t, x in zip(texts, langs) if x == lang])
                    values = np.unique(packed).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values)],
                                                     names=["lang", "gram"])

    path = shared_path(spark, "language-grams")
    training_texts(train, counts, most).mapInArrow(run, "lang string, gram long").distinct().write.parquet(path)
    known = spark.read.parquet(path)
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    bits = position_bits(max(sizes.values(), default=0), len(names))
    words = -(-len(names) // 64)
    slices = known.join(F.broadcast(counts), "lang").select("k", F.explode(_positions(F.col("gram"), bits)).alias("at")) \
        .groupBy("at", F.expr("k div 64").cast("int").alias("word")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(k % 64 as int))")).alias("mask"))
    got = slices.toArrow()  # at most a row for each position and word: MASK_BYTES
    masks = np.zeros((words, 1 << bits), np.uint64)
    masks[got.column("word").to_numpy(), got.column("at").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return LanguageFilters(names, masks)


def identify(spark: SparkSession, docs: DataFrame, model: LanguageFilters, carry: list[str] | None = None) -> DataFrame:
    shipped = Shipped(spark, model, 2 * MASK_BYTES)

    def work(texts):
        names, scores = shipped.get().predict(texts)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return append_columns(docs, work, [StructField("lang_pred", StringType()), StructField("score", DoubleType())], carry)
