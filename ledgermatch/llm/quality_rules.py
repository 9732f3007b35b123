"""Quality rules: statistics of whole texts and a learned decision list over them.

The list is learned by sequential covering. From labelled statistics a rule is grown by adding the threshold condition
with the best gain until it covers no good document of the growing part, then pruned from its end on the other part;
what it covers is taken away and the next rule is learned, until a rule no longer reaches the wanted precision. The
rules become one ordered Spark conditional expression, so applying the list is a projection inside the scan's stage.

Learning sees at most MAX_LABELLED labelled rows (those with the smallest hash of doc_id); everything else covers all
rows and whole texts.

Results at the edges: null and empty texts have statistics 0 and fail the base rules (fewer than 20 words); labelled
rows without a label or document are ignored; without labels of both kinds the list is empty and only the base rules
decide; repeated documents are judged alike; input columns named like a statistic are replaced; empty tables give none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField

from .common import append_columns, labelled_texts

MAX_LABELLED = 20_000
WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits",
         "n_marks", "n_distinct", "n_same_next", "n_bytes")
_SYMBOLS, _UPPER, _DIGITS = b"#*$%&|<>", bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A))
_MARKS = b"!?.,;:"


def repeat_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that stand twice or more."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + n]
    order = np.argsort(mixed, kind="stable")
    same = np.flatnonzero(mixed[order[1:]] == mixed[order[:-1]])
    if not len(same):
        return 0
    a, b = order[same], order[same + 1]
    equal = np.ones(len(a), bool)
    for k in range(window):
        equal &= hashes[a + k] == hashes[b + k]
    change = np.zeros(len(hashes) + 1, np.int64)
    starts = np.unique(np.concatenate([a[equal], b[equal]]))
    change[starts] += 1
    change[starts + window] -= 1
    return int((np.cumsum(change) > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """STATS of one whole text; words are ``[^\\x20\\x09-\\x0D]+``."""
    if not text:
        return (0,) * len(STATS)
    data = text.encode("utf-8", "replace")
    words = data.split()
    count = lambda drop: len(data) - len(data.translate(None, drop))
    seen, dup, lines = set(), 0, data.split(b"\n")
    for line in lines:
        if line in seen:
            dup += 1
        elif not line.isspace() and line:
            seen.add(line)
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    return (len(words), len(text) - count(b" \t\n\v\f\r"), count(_SYMBOLS), dup, repeat_words(hashes), len(lines),
            count(_UPPER), count(_DIGITS), count(_MARKS), len(set(words)),
            int((hashes[1:] == hashes[:-1]).sum()), len(data))


def with_stats(docs: DataFrame, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    def work(texts):
        rows = list(zip(*map(text_stats, texts)))
        return [pa.array(r, pa.int64()) for r in rows]

    return append_columns(docs, work, [StructField(s, LongType()) for s in STATS], carry, text)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: What rules may test: name -> (numerator, denominator) of statistics; a zero denominator gives 0.
FEATURES = {
    "n_words": ("n_words", None), "mean_word": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"), "marks": ("n_marks", "n_words"), "distinct": ("n_distinct", "n_words"),
    "same_next": ("n_same_next", "n_words"), "line_words": ("n_words", "n_lines"),
}


def features() -> list[Column]:
    out = []
    for name, (a, b) in FEATURES.items():
        value = F.col(a).cast("double")
        out.append((value if b is None else F.when(F.col(b) > 0, value / F.col(b)).otherwise(0.0)).alias("f_" + name))
    return out


# -- learning, on the driver, over a bounded sample

def _cover(rule: list, x: np.ndarray) -> np.ndarray:
    mask = np.ones(len(x), bool)
    for f, above, t in rule:
        mask &= x[:, f] > t if above else x[:, f] <= t
    return mask


def _grow(x: np.ndarray, bad: np.ndarray, cuts: int = 64, depth: int = 4) -> list:
    rule, mask = [], np.ones(len(x), bool)
    while len(rule) < depth and (mask & ~bad).any():
        p0, n0 = (mask & bad).sum(), (mask & ~bad).sum()
        best, choice = 1e-9, None
        for f in range(x.shape[1]):
            values = x[mask, f]
            marks = bad[mask]
            order = np.argsort(values, kind="stable")
            v, m = values[order], marks[order]
            ends = np.flatnonzero(v[1:] > v[:-1])
            if len(ends) > cuts:
                ends = ends[np.linspace(0, len(ends) - 1, cuts).astype(int)]
            low_bad = np.cumsum(m)[ends]
            for e, lb in zip(ends, low_bad):
                t = (v[e] + v[e + 1]) / 2
                for above, p, n in ((False, lb, e + 1 - lb), (True, p0 - lb, len(v) - e - 1 - (p0 - lb))):
                    if p > 0:
                        gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                        if gain > best:
                            best, choice = gain, (f, above, float(t))
        if choice is None:
            break
        rule.append(choice)
        mask = _cover(rule, x)
    return rule


def _prune(rule: list, x: np.ndarray, bad: np.ndarray) -> list:
    def worth(r):
        c = _cover(r, x)
        p, n = (c & bad).sum(), (c & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0
    best = max(range(1, len(rule) + 1), key=lambda k: (worth(rule[:k]), -k))
    return rule[:best]


def learn_list(x: np.ndarray, bad: np.ndarray, precision: float = 0.9, most: int = 24, least: int = 3) -> list[list]:
    """Ordered rules for ``bad`` rows: each a conjunction of (feature, above, threshold)."""
    rules, left, part = [], np.ones(len(x), bool), np.arange(len(x)) % 3 < 2
    while len(rules) < most and (left & bad).sum() >= least:
        grow, prune = left & part, left & ~part
        if not (grow & bad).any():
            break
        rule = _grow(x[grow], bad[grow])
        if not rule:
            break
        if prune.any():
            rule = _prune(rule, x[prune], bad[prune])
        cover = _cover(rule, x) & left
        hits = (cover & bad).sum()
        if hits < least or hits < precision * cover.sum():
            break
        rules.append(rule)
        left &= ~cover
    return rules


def labelled_stats(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED) -> DataFrame:
    """Features and label of at most ``most`` labelled texts that pass the base rules, one for each doc_id and label."""
    chosen = labelled_texts(docs, labels, label, most).withColumnRenamed("label", "__label")
    return with_stats(chosen, ["doc_id", "__label"]).where(~base_failed()).select("doc_id", "__label", *features())


def learn(docs: DataFrame, labels: DataFrame, **options) -> list[list]:
    rows = labelled_stats(docs, labels).orderBy("doc_id", "__label").collect()  # at most MAX_LABELLED rows of numbers
    if not rows:
        return []
    x = np.array([[r["f_" + n] for n in FEATURES] for r in rows])
    order = np.random.default_rng(1).permutation(len(rows))
    return learn_list(x[order], np.array([r["__label"] == 0 for r in rows])[order], **options)


def verdict(rules: list[list]) -> Column:
    """The ordered list as a Spark conditional: the number of the first rule that rejects, null if none does."""
    names, out = ["f_" + n for n in FEATURES], None
    for k, rule in enumerate(rules):
        cond = None
        for f, above, t in rule:
            one = F.col(names[f]) > t if above else F.col(names[f]) <= t
            cond = one if cond is None else cond & one
        out = F.when(cond, F.lit(k)) if out is None else out.when(cond, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def judge(docs: DataFrame, rules: list[list], carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns, STATS, ``base_failed``, ``rule`` (the first that rejects, else null) and ``kept``."""
    stats = with_stats(docs, carry)
    base = [c for c in stats.columns if c not in ("base_failed", "rule", "kept")]
    judged = stats.select(*base, *features(), base_failed().alias("base_failed"))
    return judged.withColumn("rule", verdict(rules)).select(*base, "base_failed", "rule") \
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
