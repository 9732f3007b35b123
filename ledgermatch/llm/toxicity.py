"""Toxicity: misspelling-tolerant lexicon search and context-window scores.

The lexicon (whole words, and word beginnings with many endings beside them) is learned from labelled texts by document
counts. Beginnings are matched as they are; a whole word keeps its own errors also where it starts with a beginning. It
is stored as a trie; intersecting the trie with a Levenshtein automaton finds the terms within the distance that a
term's length allows. The intersection is determinised lazily: a state is the set of (trie node, errors so far), and
most words leave it after a few letters. Words that clean training texts hold as well are not counted as misspellings.

Every hit is weighed by its context: hits inside quotation marks, or after a word of reporting or quoting, count less,
and the hits within WINDOW words add up. A logistic model of the weighed hits, their density and the best window gives
the score.

Learning sees at most MAX_LABELLED labelled training texts (smallest hash of doc_id, one for each doc_id and label; equal
texts once). All their terms
are weighed by Spark, however rare, short or without letters; only those with enough evidence reach the driver. Every
whole text is scored by its text alone.

Results at the edges: null and empty texts get the score of a text without hits; without toxic or without clean training
rows the lexicon is empty and every score is 0; repeated documents score alike; extra columns are carried, those named
like an output are replaced; a null doc_id is held out; empty tables give no rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField

from .common import Memo, Shipped, append_columns, labelled_texts, shared_path

MAX_LABELLED = 20_000
WINDOW = 20  # words on either side
QUOTED = 0.3  # weight of a quoted hit
MEMO_LIMIT = 300_000
REPORTING = frozenset("said says say called calls quote quoted quotes wrote writes word term slur sagte schrieb wort "
                      "dit écrit mot dijo escribió palabra".split())
_OPEN, _CLOSE, _EITHER = "“„«‹", "”»›", "\""
_STRIP = ".,;:!?()[]{}<>\"'“”„«»‹›…#*$%&|-–—_/\\"


def distance_for(term: str, beginning: bool = False) -> int:
    """Errors that a term allows; short terms, word beginnings and terms that are not all letters and marks (numbers,
    addresses) have too many neighbours to allow any."""
    return 0 if beginning or len(term) < 5 or not _spelled(term) else 1 if len(term) < 11 else 2


def _spelled(word: str) -> bool:
    return word.isalpha() or all(unicodedata.category(c)[0] in "LM" for c in word)


class FuzzyLexicon:
    """Trie of terms intersected with Levenshtein automata. ``terms``: (text, whether it is a word's beginning)."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach = [0]  # the most errors that a term below the node allows
        for k, (term, beginning) in enumerate(terms):
            at = 0
            allowed = distance_for(term, beginning)
            self.reach[0] = max(self.reach[0], allowed)
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                at = self.children[at][c]
                self.reach[at] = max(self.reach[at], allowed)
            self.ends[at].append(k)
        self._reset()

    def _reset(self):
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs) -> int:
        """The number of a state: pairs closed under skipped letters, the fewest errors for each node; -1 is dead."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if node < 0:  # a finished word beginning: accepts whatever follows
                if best.get(node, 99) > e:
                    best[node] = e
                continue
            if e > self.reach[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            for k in self.ends[node]:
                term, beginning = self.terms[k]
                if beginning and e <= distance_for(term, True):
                    todo.append((-k - 1, e))
            todo.extend((child, e + 1) for child in self.children[node].values())
        key = frozenset(best.items())
        if not key:
            return -1
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            found = [(e, k) for node, e in key if node >= 0 for k in self.ends[node] if e <= distance_for(*self.terms[k])]
            found += [(e, -node - 1) for node, e in key if node < 0]
            self.accepts.append(min(found, default=None))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        out = []
        for node, e in self.sets[state]:
            if node < 0:
                out.append((node, e))
                continue
            out.append((node, e + 1))
            for letter, child in self.children[node].items():
                out.append((child, e if letter == c else e + 1))
        got = self.steps[state][c] = self._state(out)
        return got

    def find(self, word: str) -> tuple[int, int] | None:
        """(errors, term number) of the best term, or None."""
        if len(self.sets) > 20_000:
            self._reset()
        state, steps = self.start, self.steps
        for c in word:
            nxt = steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state < 0:
                return None
        return self.accepts[state]


FEATURES = ("hits", "density", "window", "variants")


class ToxicityModel:
    """Lexicon, words that are no misspellings, and the logistic weights over FEATURES."""

    def __init__(self, terms: list[tuple[str, bool]], clean: frozenset = frozenset(), weights=None):
        self.terms, self.clean, self.weights = terms, clean, weights
        self._load()

    def __getstate__(self):
        return {"terms": self.terms, "clean": self.clean, "weights": self.weights}

    def __setstate__(self, state):
        self.__init__(**state)

    def _load(self):
        self.lexicon = FuzzyLexicon(self.terms)
        self.memo = Memo(lambda w: self.match(w) or (), MEMO_LIMIT)

    def match(self, token: str) -> tuple[int, int] | None:
        word = token.strip(_STRIP)
        found = self.lexicon.find(word) if word else None
        return None if found is None or found[0] and word in self.clean else found

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and for each hit its place, its errors and its context weight."""
        if not text:
            return 0, []
        words = text.lower().split()
        found = list(map(self.memo.__getitem__, words))
        places = [k for k, f in enumerate(found) if f]
        if not places:
            return len(words), []
        quoted = _quoted(words)
        return len(words), [(k, found[k][0], QUOTED if quoted[k] or not REPORTING.isdisjoint(
            w.strip(_STRIP) for w in words[max(0, k - 3):k]) else 1.0) for k in places]

    def features(self, text: str | None) -> tuple[float, ...]:
        n, hits = self.hits(text)
        exact = sum(w for _, e, w in hits if not e)
        variants = sum(w for _, e, w in hits if e)
        best = total = 0.0
        first = 0
        for k, _, w in hits:
            total += w
            while hits[first][0] < k - 2 * WINDOW:
                total -= hits[first][2]
                first += 1
            best = max(best, total)
        return (math.log1p(exact), math.log1p(100 * (exact + variants) / max(n, 1)), math.log1p(best), math.log1p(variants))

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        z = self.weights[0] + sum(w * f for w, f in zip(self.weights[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _quoted(words: list[str]) -> list[bool]:
    """Whether each word stands between quotation marks; a mark left open ends with its 40th word."""
    out, since = [], -1
    for k, w in enumerate(words):
        opens = w[0] in _OPEN or since < 0 and w[0] in _EITHER
        if opens:
            since = k
        out.append(since >= 0)
        tail = w.rstrip(".,;:!?")
        if since >= 0 and (tail and tail[-1] in _CLOSE + _EITHER and (len(tail) > 1 or not opens) or k - since >= 40):
            since = -1
    return out


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5, rounds: int = 30) -> list[float]:
    """Ridge-penalised logistic regression by Newton steps; the first weight is the constant."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [penalty] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _terms_of(text: str, lengths=(4, 5, 6)) -> set[tuple[str, bool]]:
    """Every word, and the beginnings of those that are spelled in letters and marks."""
    words = {w.strip(_STRIP) for w in text.lower().split()} - {""}
    out = {(w, False) for w in words}
    return out | {(w[:n], True) for w in words if len(w) > lengths[0] and _spelled(w) for n in lengths if len(w) > n}


def _count_terms(sample: DataFrame) -> DataFrame:
    """Toxic texts ``a`` and clean texts ``b`` that hold each term, summed by task before the shuffle."""
    def run(batches):
        held, size = (Counter(), Counter()), 0
        for batch in batches:
            for t, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if label in (0, 1):
                    held[1 - label].update(_terms_of(t))
                    size += len(t)
                if len(held[0]) + len(held[1]) > 300_000 or size > 20_000_000:
                    yield from map(_term_batch, held, (True, False))
                    held, size = (Counter(), Counter()), 0
        yield from map(_term_batch, held, (True, False))

    return sample.select("text", "label").mapInArrow(run, "term string, beginning boolean, a long, b long") \
        .groupBy("term", "beginning").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _term_batch(held: Counter, toxic: bool) -> pa.RecordBatch:
    counts, none = pa.array(held.values(), pa.int64()), pa.array([0] * len(held), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([t for t, _ in held], pa.string()), pa.array([b for _, b in held], pa.bool_()),
                                       *((counts, none) if toxic else (none, counts))], names=["term", "beginning", "a", "b"])


def proven(counts: DataFrame, n_toxic: int, n_clean: int, ratio: float = 10.0, evidence: float = 20.0) -> DataFrame:
    """Terms that toxic texts hold ``ratio`` times as often, by a log-likelihood ratio of ``evidence``. The evidence
    is the only floor: with a toxic share of a tenth, 5 texts suffice for a term that no clean text holds."""
    a, b, p = F.col("a"), F.col("b"), (F.col("a") + F.col("b")) / F.lit(n_toxic + n_clean)
    total = F.lit(0.0)
    for got, n in ((a, n_toxic), (b, n_clean)):
        for x, q in ((got, p), (F.lit(n) - got, 1 - p)):
            total += F.when(x > 0, 2 * x * (F.log(x) - F.log(n * q))).otherwise(0.0)
    often = (a + 0.5) / (n_toxic + 1) >= ratio * (b + 0.5) / (n_clean + 1)
    return counts.where((a > 0) & often & (total >= evidence))


def choose_terms(fine: dict) -> list[tuple[str, bool]]:
    """The lexicon from proven terms and their toxic texts; a beginning needs at least 4 proven endings. Words that start
    with a beginning stay beside it, for their misspellings."""
    endings = Counter(w[:n] for w, beginning in fine if not beginning for n in (4, 5, 6) if len(w) > n)
    stems = {t for t, beginning in fine if beginning and endings[t] >= 4}
    same = {o[:n] for o in stems for n in (4, 5) if n < len(o) and (o[:n], True) in fine
            and fine[o, True] >= 0.95 * fine[o[:n], True]}  # a longer beginning stands for almost all of their texts
    stems -= same
    stems = {s for s in stems if not any(s[:n] in stems for n in (4, 5) if n < len(s))}
    return sorted([(s, True) for s in stems] + [t for t in fine if not t[1]])


def training_fold(fold: int = 5):
    """Rows that the model may learn from; a null doc_id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) != 0, F.lit(False))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_LABELLED,
        fold: int = 5) -> ToxicityModel:
    """The model from at most ``most`` labelled rows whose crc32(doc_id) mod ``fold`` is not 0."""
    path = shared_path(spark, "toxicity-sample")
    labelled_texts(docs.where(F.length("text") > 0), labels.where(training_fold(fold)), label, most) \
        .select("text", "label").dropDuplicates(["text"]).write.parquet(path)
    sample = spark.read.parquet(path)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return ToxicityModel([])
    found = proven(_count_terms(sample), n_toxic, n_clean).collect()
    terms = choose_terms({(r["term"], r["beginning"]): r["a"] for r in found})
    draft = Shipped(spark, ToxicityModel(terms))

    def variants(batches):  # words of clean texts that are near a term without being one
        seen = set()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                model = draft.get()
                for w in set(t.lower().split()):
                    found = model.match(w)
                    if found and found[0]:
                        seen.add(w.strip(_STRIP))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["word"])

    near = sample.where("label = 0").select("text").mapInArrow(variants, "word string").distinct().collect()
    model = ToxicityModel(terms, frozenset(r["word"] for r in near))
    shipped = Shipped(spark, model)

    def measure(texts):
        rows = zip(*(shipped.get().features(t) for t in texts))
        return [pa.array(r, pa.float64()) for r in rows]

    rows = append_columns(sample, measure, [StructField(f, DoubleType()) for f in FEATURES], ["label"]).collect()
    x, y = np.array([[r[f] for f in FEATURES] for r in rows]), np.array([float(r["label"]) for r in rows])
    order = np.lexsort([*x.T, y])
    return ToxicityModel(terms, model.clean, logistic(x[order], y[order]))


def score_toxicity(spark: SparkSession, docs: DataFrame, model: ToxicityModel, carry: list[str] | None = None) -> DataFrame:
    """``score`` (0 to 1) and ``predicted`` (score >= 0.5) of every whole text."""
    shipped = Shipped(spark, model)

    def work(texts):
        own = shipped.get()
        scores = [own.score(t) for t in texts]
        return [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]

    return append_columns(docs, work, [StructField("score", DoubleType()), StructField("predicted", IntegerType())], carry)


def keep_civil(spark: SparkSession, docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs``, all columns, without the documents that the model finds toxic."""
    shipped = Shipped(spark, model)

    def work(texts):
        own = shipped.get()
        return [pa.array([own.score(t) < 0.5 for t in texts], pa.bool_())]

    return append_columns(docs, work, [StructField("__keep", BooleanType())]).where("__keep").select(*docs.columns)
