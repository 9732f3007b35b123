"""License scan: an exact set-similarity join of text blocks with license templates.

Blocks are all runs of BLOCK_WORDS consecutive words of a text, across its line breaks (a shorter text is one block).
A block and a template, as sets of words, join if the block holds at least the share ``least`` of the template's words.
All template words are ordered by the number of documents that hold them, counted over the whole corpus, rarest first.
A block that joins must hold one of the first ``|T| - need + 1`` words of the template (prefix filter, through an
inverted index), must have ``need`` template words at all (length filter), and at the first common word both sides must
have enough words left (positional filter). A block that joins makes its whole text join, so texts pass these filters first;
for the templates that are left a window over the places of their words finds the best block exactly.

Licenses share most of their words with their neighbours, so a join alone names none: a template also has marks, phrases
that tell its license apart, and gives its label where one block reaches the threshold and holds all marks, each as
consecutive words. ``blocks`` lists all joins, with and without marks.

Base phrases are found by their consecutive words. ``score`` is 1 where a base phrase stands, else the greatest share
among the joins that give a label, else 0.

Results at the edges: null and empty texts have no words and no labels; a text of any length is scanned whole; repeated
documents are labelled alike; extra columns are carried, those named like an output are replaced; empty tables give none.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField

from .common import Shipped, append_columns, folded_words

BLOCK_WORDS = 64
LEAST = 0.8

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Openings and notices of well-known licenses.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
              "version 3 of the License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]

#: What tells each template's license from others of similar words, in the order of TEMPLATES.
MARKS = [["mit license"], ["permission is hereby granted free of charge"], ["apache license"], ["compliance with the license"],
         ["gnu general public license version 3"], ["gnu general public license", "version 3"], ["cc by nc"],
         ["attribution noncommercial"], ["redistribution and use in source and binary forms"], ["mozilla public license v 2 0"]]


class TemplateIndex:
    """Templates over globally ordered words, with the inverted index of their prefixes."""

    def __init__(self, templates, frequency: dict[bytes, int], least: float = LEAST, phrases: dict = PHRASES, marks=()):
        sets = [(label, set(folded_words(t))) for label, t in templates]
        universe = set().union(*(s for _, s in sets)) if sets else set()
        self.rank = {w: k for k, w in enumerate(sorted(universe, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates, self.prefix = [], {}
        for label, words in sets:
            order = sorted(words, key=self.rank.get)
            need = max(1, math.ceil(least * len(order) - 1e-9))
            self.templates.append((label, [self.rank[w] for w in order], need))
            for i, w in enumerate(order[:len(order) - need + 1]):
                self.prefix.setdefault(self.rank[w], []).append((len(self.templates) - 1, i))
        self.starts = {w for w, r in self.rank.items() if r in self.prefix}
        self.phrases = [(folded_words(p), label) for p, label in phrases.items()]
        self.sets = [words for _, words in sets]
        self.marks = [[folded_words(m) for m in own] for own in marks] or [[] for _ in sets]

    def join(self, block: set[bytes]) -> dict[int, float]:
        """Template number -> share of its words that the block holds, for all that reach the threshold."""
        own = sorted(r for r in map(self.rank.get, block) if r is not None)
        place = {r: j for j, r in enumerate(own)}
        found, seen = {}, set()
        for j, r in enumerate(own):
            for t, i in self.prefix.get(r, ()):
                if t in seen:
                    continue
                seen.add(t)  # the first common word in the global order
                _, words, need = self.templates[t]
                if len(own) < need or 1 + min(len(words) - i - 1, len(own) - j - 1) < need:
                    continue
                common = sum(w in place for w in words)
                if common >= need:
                    found[t] = common / len(words)
        return found

    def marked(self, t: int, words: list[bytes]) -> bool:
        """Whether a block holds the template's marks and reaches its threshold."""
        marks, need = self.marks[t], self.templates[t][2]
        if not marks:
            return True
        size, tried = len(marks[0]), -1
        for p in phrase_places(words, marks[0]):
            for at in range(max(0, p + size - BLOCK_WORDS, tried + 1), min(p, max(0, len(words) - BLOCK_WORDS)) + 1):
                tried = at  # no block is tried twice
                block = words[at:at + BLOCK_WORDS]
                if len(self.sets[t].intersection(block)) >= need and all(phrase_places(block, m) for m in marks[1:]):
                    return True
        return False

    def scan(self, text: str | None):
        """n_words, places of base phrases, their labels, the joining blocks by template, and the templates that give a
        label."""
        words = folded_words(text)
        held = set(words)
        places, labels, found = [], set(), {}
        for phrase, label in self.phrases:
            if phrase and held.issuperset(phrase):
                own = phrase_places(words, phrase)
                places += own
                labels |= {label} if own else set()
        if not held.isdisjoint(self.starts):
            found = self.join(held)
            if found:
                own = [(k, r) for k, r in enumerate(map(self.rank.get, words)) if r is not None]
                runs = {t: self.joining_blocks(t, own, max(0, len(words) - BLOCK_WORDS)) for t in found}
                found = {t: r for t, r in runs.items() if r}
        return len(words), places, labels, found, [t for t in found if self.marked(t, words)]

    def joining_blocks(self, t: int, own: list[tuple[int, int]], last: int) -> list[tuple[int, int, float]]:
        """All blocks that join template ``t``, as runs of neighbouring ones: their first and last start, and the largest
        share of the template's words that one of them holds. ``own``: places and ranks of a text's template words;
        ``last``: the start of its last block.

        A word at place k stands in the blocks that start BLOCK_WORDS - 1 words before k or later, up to k; what a word
        adds to the blocks is summed over their starts."""
        _, ranks, need = self.templates[t]
        wanted, counted, change = frozenset(ranks), {}, Counter()
        for k, r in own:
            if r in wanted:
                start, stop = max(0, k - BLOCK_WORDS + 1, counted.get(r, 0)), min(k, last) + 1
                if start < stop:  # blocks that hold an earlier place of the word count it once
                    change[start] += 1
                    change[stop] -= 1
                    counted[r] = stop
        runs, held, first, best = [], 0, None, 0
        for at in sorted(change):
            held += change[at]
            if held >= need:
                first, best = (at, held) if first is None else (first, max(best, held))
            elif first is not None:
                runs.append((first, at - 1, best / len(ranks)))
                first = None
        return runs


def phrase_places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the phrase's words stand consecutively."""
    places, at = [], -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return places
        if words[at:at + len(phrase)] == phrase:
            places.append(at)


def blocks(text: str):
    """Word lists of a text's blocks, by their start: ``TemplateIndex.scan`` joins them without forming them."""
    words = folded_words(text)
    for at in range(max(1, len(words) - BLOCK_WORDS + 1)):
        yield words[at:at + BLOCK_WORDS]


def template_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """Documents that hold each template word, over all documents; a row per template word and task goes on."""
    universe = frozenset().union(*(folded_words(t) for _, t in templates)) if templates else frozenset()

    def run(batches):
        held = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    held.update(universe.intersection(folded_words(t)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()),
                                          pa.array(held.values(), pa.int64())], names=["word", "n"])

    counts = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in counts.collect()}  # at most one row per template word


def scan_licenses(spark: SparkSession, docs: DataFrame, templates=TEMPLATES, phrases: dict = PHRASES,
                  least: float = LEAST, carry: list[str] | None = None, marks=None) -> DataFrame:
    """``n_words, n_base, first_word, last_word, base_labels, labels, score`` and
    ``blocks``: the template joins as text ``label:template number:largest share``, comma-joined; ``block_runs``: all
    joining blocks as text ``template number:first start-last start:largest share``, a run of neighbouring blocks in one
    (a block's start is its first word, from 0; '' when none). ``marks``: a list of phrases for each template (those of
    TEMPLATES by default, none for other templates)."""
    marks = MARKS if marks is None and templates is TEMPLATES else marks or ()
    index = Shipped(spark, TemplateIndex(templates, template_frequencies(docs, templates), least, phrases, marks))
    fields = [StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()),
              StructField("last_word", LongType()), StructField("base_labels", StringType()),
              StructField("labels", StringType()), StructField("score", DoubleType()), StructField("blocks", StringType()),
              StructField("block_runs", StringType())]

    def work(texts):
        own, rows = index.get(), []
        for t in texts:
            n, places, base, found, named = own.scan(t)
            more = {own.templates[k][0] for k in named}
            rows.append((n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                         ",".join(sorted(base | more)), 1.0 if places else max((b[2] for k in named for b in found[k]), default=0.0),
                         ",".join(f"{own.templates[k][0]}:{k}:{max(v for _, _, v in runs):.4f}" for k, runs in sorted(found.items())),
                         ",".join(f"{k}:{a}-{z}:{v:.4f}" for k, runs in sorted(found.items()) for a, z, v in runs)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.string()]
        return [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]

    return append_columns(docs, work, fields, carry)
