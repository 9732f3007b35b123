"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word shingles (WORDS consecutive lower-cased words; a shorter text with words is one shingle). Texts
with equal sets form a class and are joined through one representative.

1. One pass makes 128 MinHash values of 16 bits for each text, packed as 32 bands of four.
2. Representatives that share a band meet. Band values that no one shares are dropped by a count first. A band value that
   more than BLOCK representatives share is dealt out as blocks, and every pair of blocks is a cell of its own, so that a
   task's rows stay bounded whatever a group holds.
3. In a cell the MinHash values of all pairs are compared 16 at a time. After n comparisons with m matches the posterior
   of the similarity is Beta(m + 1, n - m + 1); a pair goes as soon as the posterior probability of the threshold falls
   below TOLERANCE. The cells give only a spanning forest of the pairs left, and its components are the groups of texts
   that any link can lie in.
4. The shingle sets of these texts alone are made again and meet group by group, large groups again in cells of blocks.
   Pairs that share a band are pruned as before and what is left is verified exactly. A cell gives each text's number of
   links and a spanning forest of the links; no list of all pairs is ever made.

A link of similarity s shares none of 32 bands with probability (1 - s^4)^32, 5e-8 at 0.8, and is pruned with a
probability near TOLERANCE. No group, bucket or candidate list is capped. The pairs of one group of m different texts are
compared in m^2 / BLOCK rows of work, the exact count of links cannot do with less than looking at them.

Results at the edges: null texts and texts without words link to nothing and are classes of their own; repeated rows and
copies link to each other (each counts); rows with a null doc_id take part, their class_id is the smallest doc_id of the
class that is not null; other input columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import folded_words, shared_path, text_runs
from .components import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
TOLERANCE = 1e-6
BLOCK = 1024  # rows of a block in a cell
BLOCK_SHINGLES = 1_000_000
PAIRS = 500_000  # pairs compared at a time
_U = np.uint64


class WordHashes(dict):
    """64-bit hashes of words, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        got = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:  # long tokens seldom come again
            self[word] = got
        return got


def shingles(text: str | None, memo: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = folded_words(text)
    if not words:
        return np.zeros(0, _U)
    hashes = np.fromiter(map(memo.__getitem__, words), _U, len(words))
    size = min(WORDS, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, _U)
    for k in range(size):
        out = (out ^ hashes[k:k + n]) * _U(0x9E3779B97F4A7C15)
        out ^= out >> _U(32)
    return np.unique(out)


def _permutations(count: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2 ** 63, count, dtype=_U)[:, None] * _U(2) + _U(1), rng.integers(0, 2 ** 63, count, dtype=_U)[:, None]


def signature(own: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """128 MinHash values as 32 64-bit bands of four 16-bit values."""
    low = np.full(len(a), ~_U(0))
    for at in range(0, len(own), 512):
        np.minimum(low, (a * own[None, at:at + 512] + b).min(axis=1), out=low)
    low ^= low >> _U(29)
    return (low * _U(0xBF58476D1CE4E5B9) >> _U(48)).astype(np.uint16).view(np.int64)


SIGNED = StructType([StructField("key", BinaryType()), StructField("sig", ArrayType(LongType(), False)),
                     StructField("size", IntegerType())])


def sign(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``hash`` of the text, ``key`` (a 128-bit hash of the shingle set; null without words), ``sig`` and the
    set's ``size``."""
    schema = StructType([docs.schema["doc_id"], StructField("hash", LongType())] + SIGNED.fields)

    def run(batches):
        memo, (a, b) = WordHashes(), _permutations()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            keys, sigs, sizes = [], [], []
            for t in texts:
                own = shingles(t, memo)
                sizes.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                sigs.append(signature(own, a, b) if len(own) else np.zeros(BANDS, np.int64))
            flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(flat)),
                 pa.array(sizes, pa.int32())], names=schema.names)

    return docs.select("doc_id", F.xxhash64(text).alias("__hash"), F.col(text).alias("__text")).mapInArrow(run, schema)


# -- pruning

def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = 16, count: int = BANDS * ROWS
                  ) -> list[int]:
    """After step, 2 * step, ... comparisons: the fewest matches whose posterior keeps the pair.

    With a uniform prior, P(similarity >= t | m of n match) is P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(step, count + 1, step):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def prune(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a[k], b[k]) of rows of ``sig`` (rows by 128 values) that survive every round."""
    step = sig.shape[1] // len(least)
    found = np.zeros(len(a), np.int32)
    for r, need in enumerate(least):
        part = sig[:, r * step:(r + 1) * step]
        found += (part[a] == part[b]).sum(axis=1, dtype=np.int32)
        alive = found >= need
        if not alive.all():
            a, b, found = a[alive], b[alive], found[alive]
        if not len(a):
            break
    return a, b


def forest(n: int, a: np.ndarray, b: np.ndarray, parent: list[int] | None = None) -> list[int]:
    """Union-find over 0..n-1: the root (the smallest member) of each."""
    parent = list(range(n)) if parent is None else parent

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return parent


def roots(parent: list[int]) -> list[int]:
    out = []
    for x in range(len(parent)):  # a parent is never larger than its child
        out.append(x if parent[x] == x else out[parent[x]])
    return out


def cell_pairs(left: np.ndarray, right: np.ndarray, same: bool):
    """All pairs of rows of two blocks (of one block with itself if ``same``), PAIRS at a time."""
    rows = max(1, PAIRS // max(1, len(right)))
    for at in range(0, len(left), rows):
        a = np.repeat(left[at:at + rows], len(right))
        b = np.tile(right, len(left[at:at + rows]))
        if same:
            keep = a < b
            a, b = a[keep], b[keep]
        if len(a):
            yield a, b


def runs_of(batches, keys: int):
    """Record batches of consecutive rows, sorted by their first ``keys`` columns, as one table for each key."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        columns = [np.array(batch.column(k).to_pylist(), dtype=object) for k in range(keys)]
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(starts[:-1], starts[1:]):
            key = tuple(c[s] for c in columns)
            if last is not None and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def signatures_of(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, BANDS * ROWS)


EDGES = StructType([StructField("a", BinaryType()), StructField("b", BinaryType())])


def _cells(rows: DataFrame, blocks, key: str) -> DataFrame:
    """Each row once for every cell of its block: columns i <= j, and ``part`` (the row's own block)."""
    n = F.greatest(blocks, F.lit(1)).cast("int")
    dealt = rows.withColumn("__n", n).withColumn("part", F.pmod(F.xxhash64(key, F.lit(7)), F.col("__n")).cast("int"))
    return dealt.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))) \
        .withColumn("i", F.least("part", "__o")).withColumn("j", F.greatest("part", "__o")).drop("__n", "__o")


def likely_pairs(spark: SparkSession, reps: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """Edges (a, b) that span, in every bucket of a shared band, the pairs that pruning leaves."""
    least = least_matches(threshold, tolerance)
    bands = reps.select("key", F.posexplode("sig").alias("band", "value")) \
        .select("key", F.xxhash64("band", "value").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    active = bands.join(shared, "bucket")
    cells = _cells(active, F.ceil(F.col("n") / block), "key").select("bucket", "i", "j", "part", "key")
    # signatures come in once a row's buckets are known: most texts share no band with anyone
    rows = cells.join(reps.select("key", "sig"), "key").select("bucket", "i", "j", "part", "key", "sig")

    def run(batches):
        for group, sig, part, keys in _bounded(batches):
            found_a, found_b = [], []
            for a, b in _group_pairs(group, part):
                a, b = prune(sig, a, b, least)
                found_a.append(a)
                found_b.append(b)
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))
            root = roots(forest(len(keys), a, b))
            edges = [(keys[r], keys[k]) for k, r in enumerate(root) if r != k]
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.binary()),
                                                  pa.array([e[1] for e in edges], pa.binary())], names=["a", "b"])

    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, EDGES).distinct()


def _bounded(batches):
    """Whole cells in runs of a few thousand rows: (group numbers, signatures, parts, keys)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        code = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)
        change = np.flatnonzero((code[1:] != code[:-1]).any(axis=1)) + 1
        if held:  # does the first row go on with the cell that is held?
            last = [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in range(3)]
            if last != code[0].tolist():
                yield _unpack(held)
                held = []
        if len(change):
            held.append(batch.slice(0, int(change[-1])))
            yield _unpack(held)
            held = [batch.slice(int(change[-1]))]
        else:
            held.append(batch)
    if held:
        yield _unpack(held)


def _unpack(held):
    t = pa.Table.from_batches(held).combine_chunks()
    code = np.stack([t.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
    group = np.concatenate([[0], np.cumsum((code[1:] != code[:-1]).any(axis=1))])
    part = np.where(code[:, 1] == code[:, 2], 2, t.column(3).to_numpy() == code[:, 2])  # 2: one block with itself
    return group, signatures_of(t.column(5)), part, t.column(4).to_pylist()


def _group_pairs(group: np.ndarray, part: np.ndarray):
    """Pairs of rows of one group, PAIRS at a time: groups of a size together, large ones alone."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(group)]]))
    plain = part[starts] == 2
    for size in np.unique(sizes[plain & (sizes <= 64)]):
        if size < 2:
            continue
        a, b = np.triu_indices(size, 1)
        own = starts[plain & (sizes == size)]
        step = max(1, PAIRS // len(a))
        for at in range(0, len(own), step):
            base = own[at:at + step, None]
            yield (base + a).ravel(), (base + b).ravel()
    for s, n in zip(starts[~plain | (sizes > 64)], sizes[~plain | (sizes > 64)]):
        rows = np.arange(s, s + n)
        if part[s] == 2:
            yield from cell_pairs(rows, rows, True)
        else:
            yield from cell_pairs(rows[part[s:s + n] == 0], rows[part[s:s + n] == 1], False)


# -- exact verification

def verify(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, limit: Fraction) -> np.ndarray:
    """Which pairs reach the threshold exactly."""
    sizes = np.array([len(s) for s in sets])
    used = np.unique(np.concatenate([a, b]))
    _, codes = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(sizes[used])])
    place = {k: n for n, k in enumerate(used.tolist())}
    own = [codes[ends[n]:ends[n + 1]] for n in range(len(used))]
    flag = np.zeros(int(codes.max()) + 1, bool)
    common = np.zeros(len(a), np.int64)
    order = np.argsort(a, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
        mine = own[place[int(a[run[0]])]]
        flag[mine] = True
        partners = [own[place[k]] for k in b[run].tolist()]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in partners])[:-1]])
        common[run] = np.add.reduceat(flag[np.concatenate(partners)].astype(np.int64), starts)
        flag[mine] = False
    union = sizes[a] + sizes[b] - common
    return limit.denominator * common >= limit.numerator * union


def links(spark: SparkSession, groups: DataFrame, docs: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """``a, b, n``: for b null, n more links of text a; else an edge of a spanning forest of the links.

    ``groups``: key, rep (a doc_id that has the text), hash (of a text with that id), copies, sig, size, label."""
    limit, least = Fraction(threshold).limit_denominator(1000), least_matches(threshold, tolerance)
    sized = groups.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    members = groups.join(sized, "label")
    fields = ["label", "n", "total", "copies", "key", "sig"]
    schema = StructType([members.schema[f] for f in fields] + [StructField("own", ArrayType(LongType(), False))])
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("rep"), F.col("text").alias("__text")) \
        .join(members, "rep").select(*fields, "__text")
    nameless = docs.where("doc_id IS NULL AND text IS NOT NULL").select(F.xxhash64("text").alias("hash"), F.col("text").alias("__text")) \
        .dropDuplicates(["hash"]).join(members.where("rep IS NULL"), "hash").select(*fields, "__text")

    def remake(batches):
        memo = WordHashes()
        for batch in batches:
            for s, e, some in text_runs(batch, len(fields)):
                keys = batch.column(4).slice(s, e - s).to_pylist()
                sets = [shingles(t, memo) for t in some]
                keep = [k for k, (own, key) in enumerate(zip(sets, keys)) if xxhash.xxh3_128_digest(own.tobytes()) == key]
                rows = pa.RecordBatch.from_arrays(batch.columns[:len(fields)], names=fields).slice(s, e - s) \
                    .take(pa.array(keep, pa.int64()))
                kept = [sets[k] for k in keep]
                ends = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
                flat = np.concatenate(kept).view(np.int64) if kept else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(rows.columns + [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                                                 names=schema.names)

    sets = texts.union(nameless).mapInArrow(remake, schema)
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("total") / BLOCK_SHINGLES))
    cells = _cells(sets, blocks, "key").select("label", "i", "j", "part", "copies", "key", "sig", "own")
    out = StructType(EDGES.fields + [StructField("n", LongType())])

    def run(batches):
        for (_, i, j), t in runs_of(batches, 3):
            t = t.combine_chunks()
            keys, first = t.column("key").to_pylist(), {}
            for k, key in enumerate(keys):
                first.setdefault(key, k)  # a repeated row of one representative stands once
            rows = np.array(sorted(first.values()))
            if len(rows) < 2:
                continue
            sig, part = signatures_of(t.column("sig")), t.column("part").to_numpy()
            flat = t.column("own").combine_chunks() if isinstance(t.column("own"), pa.ChunkedArray) else t.column("own")
            values, ends = flat.values.to_numpy(), flat.offsets.to_numpy()
            own = [values[s:e] for s, e in zip(ends[:-1], ends[1:])]
            copies = t.column("copies").to_numpy()
            n_links, parent = np.zeros(len(keys), np.int64), None
            left = rows if i == j else rows[part[rows] == i]
            right = rows if i == j else rows[part[rows] == j]
            for a, b in cell_pairs(left, right, i == j):
                near = np.zeros(len(a), bool)
                bands = sig.view(np.int64)
                for r in range(BANDS):
                    near |= bands[a, r] == bands[b, r]
                a, b = prune(sig, a[near], b[near], least)
                if not len(a):
                    continue
                true = verify(own, a, b, limit)
                a, b = a[true], b[true]
                np.add.at(n_links, a, copies[b])
                np.add.at(n_links, b, copies[a])
                parent = forest(len(keys), a, b, parent)
            if parent is None:
                continue
            rows_a = [(keys[k], None, int(n_links[k])) for k in rows.tolist() if n_links[k]]
            rows_a += [(keys[r], keys[k], 0) for k, r in enumerate(roots(parent)) if r != k]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows_a], pa.binary()),
                                              pa.array([r[1] for r in rows_a], pa.binary()),
                                              pa.array([r[2] for r in rows_a], pa.int64())], names=out.names)

    return cells.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(run, out)


def _classified(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
                block: int = BLOCK) -> DataFrame:
    """The rows of ``jaccard_join`` with ``hash`` of the text, ``key`` and ``first``: the (doc_id, hash) that stands first
    in the row's class."""
    def written(df, label):
        path = shared_path(spark, label)
        df.write.parquet(path)
        return spark.read.parquet(path)

    signed = written(sign(docs), "signed")
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "hash"))
    reps = written(signed.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.min("hash").alias("hash"), F.min(named).alias("first"), F.count(F.lit(1)).alias("copies"),
        F.first("sig").alias("sig"), F.first("size").alias("size")), "reps")
    likely = components(spark, likely_pairs(spark, reps, threshold, tolerance, block))
    groups = written(reps.drop("first").join(likely.withColumnRenamed("node", "key"), "key"), "groups")
    found = written(links(spark, groups, docs, threshold, tolerance, block), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("linked"))
    labels = components(spark, found.where("b is not null").select("a", "b")).withColumnRenamed("node", "key")
    classes = reps.select("key", "first").join(labels, "key")
    smallest = classes.groupBy("label").agg(F.min("first").alias("__first"))
    linked = classes.join(smallest, "label").join(counts, "key", "left").select("key", "__first", "linked")
    per_key = written(reps.select("key", "first", "copies").join(linked, "key", "left").select(
        "key", F.coalesce("__first", "first").alias("first"), "copies",
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    return signed.select("doc_id", "hash", "key").join(per_key, "key", "left").select(
        "doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("copies"), "hash", "key", "first")


def jaccard_join(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (the smallest doc_id that links lead to), ``n_links`` (other
    documents at or above the threshold) and ``copies`` (documents with the same shingle set, itself included).

    Options: ``threshold``, ``tolerance`` (of the pruning), ``block`` (rows of a block in a cell)."""
    return _classified(spark, docs, **options).select("doc_id", "class_id", "n_links", "copies")


def one_of_each(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class: the one of the smallest doc_id. Decided by doc_id and text, so that of
    rows that repeat a doc_id only those with like texts go; rows without a doc_id and texts without words stay."""
    own = F.struct("doc_id", "hash")
    found = _classified(spark, docs, **options).where("key IS NOT NULL AND doc_id IS NOT NULL")
    gone = found.where(own != F.col("first")).select("doc_id", F.col("hash").alias("__hash")).distinct()
    twice = found.where(own == F.col("first")).groupBy("doc_id", F.col("hash").alias("__hash")).count().where("count > 1").drop("count")
    kept = docs.withColumn("__hash", F.xxhash64("text")).join(gone, ["doc_id", "__hash"], "left_anti")
    once = kept.join(twice, ["doc_id", "__hash"], "left_semi").dropDuplicates(["doc_id", "__hash"])
    return kept.join(twice, ["doc_id", "__hash"], "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
