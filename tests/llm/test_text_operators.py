import hashlib
import random
import re

import numpy as np
import pytest

from ledgermatch.llm import decontaminate as D, language_id as L, license_scan as S, quality_rules as Q
from ledgermatch.llm.common import folded_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def sentence(rng, n, words=40):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_words():
    for t in (None, "", "A-b'c 9É\x7fñ  x\x85y", "ÀB\n"):
        assert [w.decode() for w in folded_words(t)] == plain_words(t)


# -- decontamination

@pytest.fixture
def benchmark(spark):
    rng = random.Random(5)
    rows = [(k, sentence(rng, n)) for k, n in enumerate((30, 13, 14, 5, 1, 0, 40))] + [(7, None), (None, sentence(rng, 20)),
                                                                                      (1, sentence(rng, 13)), (8, "")]
    rows.append((9, rows[0][1]))
    return spark.createDataFrame(rows, "item_id long, text string")


def brute_hits(text, items):
    words, hit, found = plain_words(text), set(), set()
    for name, item in items:
        own = plain_words(item)
        n = min(13, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            for at in range(len(words) - n + 1):
                if words[at:at + n] == own[k:k + n]:
                    hit.update(range(at, at + n))
                    found.add("null" if name is None else str(name))
    return words, hit, found


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_contamination(spark, frame, benchmark, block_bytes):
    rng = random.Random(6)
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    texts = [None, "", "nothing here", items[0][1].upper().replace(" ", ", "), items[0][1] + " " + items[2][1],
             sentence(rng, 900) + "\n" + " ".join(items[6][1].split()[3:20]) + " end", sentence(rng, 3000),
             items[8][1], items[8][1], " ".join(items[0][1].split()[:12])]
    found = {r["doc_id"]: r for r in D.contamination(spark, frame(texts, n_words=["old"] * len(texts)), benchmark,
                                                     block_bytes=block_bytes).collect()}
    assert len(found) == len(texts)
    for k, t in enumerate(texts):
        words, hit, names = brute_hits(t, items)
        r = found[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items"]) == (len(words), len(hit), len(names), sorted(names))
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(words))


def test_decontaminate_removal(spark, frame, benchmark):
    item = benchmark.where("item_id = 6").first()["text"]
    words = item.split()
    texts = ["clean text", None, item, "x " * 900 + " ".join(words[:13]) + ". y"]
    docs = frame(texts, source=["s"] * 4)
    kept = D.remove_documents(spark, docs, benchmark)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 3}
    cut = {r["doc_id"]: r["text"] for r in D.remove_spans(spark, docs, benchmark).collect()}
    assert cut[0] == "clean text" and cut[1] is None and cut[2] == "" and cut[3] == "x " * 900 + ". y"
    none = D.contamination(spark, docs, benchmark.limit(0)).collect()
    assert len(none) == 4 and not any(r["contaminated"] for r in none)
    assert D.contamination(spark, docs.limit(0), benchmark).count() == 0


def test_items_digest(spark):
    got = spark.createDataFrame([(["10", "2"],), ([],)], "items array<string>").select(D.items_digest().alias("d")).collect()
    assert [r["d"] for r in got] == [hashlib.sha256(x).hexdigest() for x in (b"10,2", b"")]


# -- quality rules

def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    covered = {k + n for k, w in enumerate(windows) if windows.count(w) > 1 for n in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_stats(spark, frame):
    rng = random.Random(7)
    texts = [None, "", " \n\t ", "a", "é#*\x85b\nx\n\nx\n x", "a b c d e f g h " * 4, "z " * 5000] + [
        "\n".join(sentence(rng, rng.randrange(30), 3) for _ in range(5)) for _ in range(40)]
    got = {r["doc_id"]: r for r in Q.with_stats(frame(texts, n_words=["old"] * len(texts))).collect()}
    for k, t in enumerate(texts):
        want = brute_stats(t)
        assert tuple(got[k][s] for s in Q.STATS[:5]) == want
    judged = {r["doc_id"]: r for r in Q.judge(frame(texts), []).collect()}
    for k, t in enumerate(texts):
        n, *_, repeats = brute_stats(t)
        assert judged[k]["base_failed"] == (n < 20 or 100 * repeats > 30 * n)
        assert judged[k]["kept"] == (not judged[k]["base_failed"])


def test_rules_are_learned_and_emitted(spark, frame):
    rng = random.Random(8)
    good = [sentence(rng, 40, 400) for _ in range(80)]
    bad = [" ".join(w.upper() + "#" for w in sentence(rng, 40, 400).split()) for _ in range(40)]
    docs = frame(good + bad)
    labels = spark.createDataFrame([(k, int(k < 80)) for k in range(120)] + [(None, 1), (5000, 0)], "doc_id long, quality int")
    rules = Q.learn(docs, labels)
    assert rules
    kept = {r["doc_id"] for r in Q.judge(docs, rules).where("kept").collect()}
    assert kept == set(range(80))
    assert Q.learn(docs, labels.limit(0)) == [] and Q.judge(docs.limit(0), rules).count() == 0
    x = np.array([[0.0], [1.0], [2.0], [3.0]] * 10)
    for rule in Q.learn_list(x, x[:, 0] > 1.5):
        assert rule == [(0, True, 1.5)]


# -- license scan

def test_license_scan_equals_brute_force(spark, frame):
    rng = random.Random(9)
    texts = [None, "", "Released under the MIT License.", "x y\nLicensed under CC BY-NC 4.0. and cc by nc",
             "licensed apache under the license version 2 0 x", "This work is licensed under GNU General Public License version 3",
             sentence(rng, 300) + " Licensed under the Apache License, Version 2.0 " + sentence(rng, 300), "mit", "same mit license"]
    vocabulary = sorted({w.decode() for _, t in S.TEMPLATES for w in folded_words(t)})
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 90))) for _ in range(60)]
    for _ in range(60):  # marks within, at and beyond a block's reach of the rest
        parts = [rng.choice(rng.choice(S.MARKS)), *rng.choice(S.TEMPLATES)[1].split(), *["x"] * rng.randrange(60)]
        texts.append(" ".join(rng.sample(parts, len(parts))) + " x" * rng.randrange(20))
    docs = frame(texts, score=["old"] * len(texts))
    got = {r["doc_id"]: r for r in S.scan_licenses(spark, docs, least=0.6).collect()}
    for k, t in enumerate(texts):
        words, places, labels = plain_words(t), [], set()
        for phrase, label in S.PHRASES.items():
            p = phrase.split()
            at = [n for n in range(len(words)) if words[n:n + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        joins, named = {}, set()
        for block in S.blocks(t or ""):
            for n, (label, template) in enumerate(S.TEMPLATES):
                want = set(folded_words(template))
                share = len(want & set(block)) / len(want)
                if share >= 0.6:
                    joins[n] = max(share, joins.get(n, 0))
                    whole = " " + " ".join(w.decode() for w in block) + " "
                    if all(f" {m} " in whole for m in S.MARKS[n]):
                        named.add(n)
        r = got[k]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(labels))
        assert r["labels"] == ",".join(sorted(labels | {S.TEMPLATES[n][0] for n in named}))
        assert r["score"] == pytest.approx(1.0 if places else max((joins[n] for n in named), default=0.0))
    assert S.scan_licenses(spark, docs.limit(0)).count() == 0


WRAPPED = {
    "mit": "# Permission is hereby granted, free of charge, to any person obtaining a copy\n"
           "# of this software and associated documentation files (the \"Software\"), to deal\n",
    "apache-2": " * you may not use this file except in compliance with the License.\n"
                " * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n",
    "bsd": "// Redistribution and use in source and binary forms, with or without\n"
           "// modification, are permitted provided that the following conditions are\n// met:\n",
    "mpl-2": "/* This Source Code Form is subject to the terms of the Mozilla Public\n"
             " * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at x */\n",
}


def test_wrapped_notices_are_found(spark, frame):
    rng = random.Random(19)
    fill = lambda n: "\n".join(sentence(rng, 7) for _ in range(n)) + "\n"
    texts = list(WRAPPED.values()) + [fill(a) + t + fill(30) for t in WRAPPED.values() for a in range(9)]
    texts += [" ".join(fill(a).split() + t.split() + fill(20).split()) for t in WRAPPED.values() for a in range(0, 30, 3)]
    vocabulary = sorted({w.decode() for _, t in S.TEMPLATES for w in folded_words(t)})
    texts += [re.sub(" ", lambda _: rng.choice("   \n"), " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(400))))
              for _ in range(40)]
    got = {r["doc_id"]: r for r in S.scan_licenses(spark, frame(texts)).collect()}
    for k, t in enumerate(texts):
        words, best = plain_words(t), {}
        for n, (_, template) in enumerate(S.TEMPLATES):
            own = set(plain_words(template))
            share = max(len(own & set(words[at:at + 64])) / len(own) for at in range(max(1, len(words) - 63)))
            if share >= 0.8:
                best[n] = share
        assert got[k]["blocks"] == ",".join(f"{S.TEMPLATES[n][0]}:{n}:{v:.4f}" for n, v in best.items())
        for label, notice in WRAPPED.items():
            if notice in t or " ".join(notice.split()) in t:
                assert label in got[k]["labels"].split(",")


def test_every_joining_block_is_returned(spark, frame):
    rng = random.Random(23)
    vocabulary = sorted({w.decode() for _, t in S.TEMPLATES for w in folded_words(t)})
    texts = [None, "", "mit license"]
    for _ in range(60):  # notices far apart, close together, repeated, and loose words of theirs
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts += rng.choice(S.TEMPLATES)[1].split() if rng.random() < 0.7 else rng.choices(vocabulary, k=rng.randrange(1, 40))
            parts += ["x"] * rng.choice((0, 3, 30, 70, 200))
        texts.append(" ".join(parts))
    got = {r["doc_id"]: r["block_runs"] for r in S.scan_licenses(spark, frame(texts), least=0.7).collect()}
    several = 0
    for k, t in enumerate(texts):
        want = []
        for n, (_, template) in enumerate(S.TEMPLATES):
            own, runs = set(folded_words(template)), []
            for at, block in enumerate(S.blocks(t or "")):
                share = len(own & set(block)) / len(own)
                if share >= 0.7:
                    if runs and runs[-1][1] == at - 1:
                        runs[-1] = (runs[-1][0], at, max(share, runs[-1][2]))
                    else:
                        runs.append((at, at, share))
            several += len(runs) > 1
            want += [f"{n}:{a}-{z}:{v:.4f}" for a, z, v in runs]
        assert got[k] == ",".join(want)
    assert several > 10


def test_neighbouring_licenses_get_no_wrong_label(spark, frame):
    cases = {
        "released under the GPL license": "", "A new trailer was released under the hood; the license plate": "",
        "Licensed under CC BY-SA 4.0": "", "Licensed under CC BY 4.0": "", "Licensed under the GNU General Public License, Version 2.0": "",
        "This work is licensed under the Mozilla Public License, version 3": "",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License": "",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License": "gpl-3",
        "This work is licensed under the GNU General Public License, version 3": "gpl-3", "Released under the MIT License": "mit",
        "Licensed under CC BY-NC 4.0": "cc-by-nc", "Released under MIT license terms: the work": "mit", "": "",
        "mit license " + "x " * 80 + "released under the license": "", "mit license " + "x " * 40 + "released under the license": "mit"}
    got = S.scan_licenses(spark, frame(list(cases))).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == list(cases.values())
    assert all((r["score"] > 0) == bool(r["labels"]) for r in got) and got[0]["blocks"].startswith("mit:0:")
    other = S.scan_licenses(spark, frame(["one two three", "one two"]), [("own", "one two three")], {}, 0.9).collect()
    assert [r["labels"] for r in other] == ["own", ""]


# -- language

def test_language_filters(spark, frame):
    rng = random.Random(10)
    syllables = {"xx": "ka lo mi tu".split(), "yy": "ßer gün wöh tzu".split(), "zz": "ché ñon qui rra".split()}
    texts, langs = [], []
    for lang, parts in syllables.items():
        for _ in range(60):
            texts.append(" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(30)))
            langs.append(lang)
    docs = frame(texts, lang=langs, score=["old"] * len(texts))
    model = L.fit(docs.where(~L.held_out()))
    got = L.identify(spark, docs, model).collect()
    assert all(r["lang"] == r["lang_pred"] for r in got) and all(0 <= r["score"] <= 1 for r in got)
    odd = L.identify(spark, frame([None, "", "12 !?", "KA LO", "é"]), model, ["doc_id"]).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in odd][:4] == ["und", "und", "und", "xx"] and odd[4]["lang_pred"] in syllables
    nothing = L.fit(docs.limit(0))
    assert {r["lang_pred"] for r in L.identify(spark, docs, nothing).collect()} == {"und"}


def filters_of(profiles, bits):
    names = list(profiles)
    masks = np.zeros((-(-len(names) // 64), 1 << bits), np.uint64)
    for k, name in enumerate(names):
        for h in L.HASHES:
            masks[k // 64, (profiles[name] * np.uint32(h)) >> np.uint32(32 - bits)] |= np.uint64(1 << k % 64)
    return masks


def test_language_counts_equal_brute_force():
    profiles = {"b": np.arange(0, 2000, 7, dtype=np.uint32), "a": np.array([1, 5, 9], np.uint32)}
    texts = ["the cat", None, "", "A b", "ééé x"]
    packed, ends = L.grams(texts)
    own = []
    for t in texts:
        data = b" " + (t or "").lower().encode().translate(L._FOLD) + b" "
        own.append([g for k in range(len(data) - 3) for g in [data[k:k + 4]]
                    if not (g[1] == 32 and 32 in (g[0], g[2]) or g[2] == g[3] == 32)])
    assert np.diff([0, *ends]).tolist() == [len(x) for x in own]
    assert packed.tolist() == [int.from_bytes(g, "little") for x in own for g in x]
    model = L.LanguageFilters(list(profiles), filters_of(profiles, 12))
    for k, name in enumerate(model.names):  # every member is found
        hit = np.ones(len(profiles[name]), bool)
        for h in L.HASHES:
            hit &= (model.masks[0][model.at(profiles[name], h)] >> np.uint8(k)) & 1 == 1
        assert hit.all()


def test_language_masks_hold_every_gram_of_every_language(spark):
    rng = random.Random(30)
    rows = []
    for k in range(300):  # more languages than one mask word, and than any former bound
        for n in range(3):
            rows.append((1000 * k + n, f"l{k:03d}", " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(20))))
    rows += [(None, "l000", "zzzz yyyy"), (5, None, "qqqq"), (6, "l001", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = L.fit(docs)
    by = {}
    for i, lang, text in rows:
        if i is not None and lang and text:
            by.setdefault(lang, []).append(text)
    assert sorted(model.names) == sorted(by) and len(model.masks) == 5
    want = filters_of({n: np.unique(L.grams(by[n])[0]) for n in model.names}, model.bits)
    assert (want == model.masks).all() and (model.false < L.FALSE_RATE).all()
    got = L.identify(spark, docs.where("text is not null and lang is not null and doc_id is not null"), model, ["lang"])
    assert got.where("lang <> lang_pred").count() == 0


def test_language_sample_is_by_ids_and_clashing_columns_are_replaced(spark):
    rows = [(k, "xx" if k % 3 else "yy", f"text {k}", "old", "old") for k in range(9000)] + [(7, "xx", f"again {k}", "o", "o") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, lang_pred string, score string")
    counts = docs.groupBy("lang").count().withColumnRenamed("count", "n")
    few = L.training_texts(docs, counts, 200).groupBy("lang").count().collect()
    assert all(60 < r["count"] < 300 for r in few) and len(few) == 2
    again = L.identify(spark, docs, L.fit(docs))
    assert sorted(again.columns) == sorted(docs.columns) and dict(again.dtypes)["score"] == "double"
    null = spark.createDataFrame([(None,), (3,)], "doc_id long").select(L.held_out().alias("h")).collect()
    assert null[0]["h"] is True and null[1]["h"] is not None


@pytest.mark.parametrize("carry", [["doc_id"], None])
def test_blocks_of_a_large_benchmark_equal_one_set(spark, carry):
    rng = random.Random(31)
    items = [(f"i{k}", " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 5, 13, 30])))) for k in range(60)] + [("i1", "x y z"), (None, "q r s")]
    texts = [None, "", "q r s"] + [" ".join(rng.choice("abcdefgh") for _ in range(40)) + " " + " ".join(t for _, t in rng.sample(items, 3)) for _ in range(80)]
    docs = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts + texts[:20])], "doc_id long, text string, n_hit string")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    size = sum(len(t) for _, t in items)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items", "contaminated"]
    whole = D.contamination(spark, docs, benchmark, carry=carry).select(*columns).collect()
    parts = D.contamination(spark, docs, benchmark, carry=carry, block_bytes=-(-size // 3)).select(*columns).collect()
    assert sorted(map(str, whole)) == sorted(map(str, parts)) and any(r["n_items"] > 2 for r in whole)
    kept = D.remove_documents(spark, docs, benchmark, block_bytes=-(-size // 4))
    assert kept.columns == docs.columns and kept.count() == sum(not r["contaminated"] for r in whole)
