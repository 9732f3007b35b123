import random
from collections import Counter

import numpy as np
import pytest

from ledgermatch.llm import jaccard_join as J, shard_shuffle as H
from ledgermatch.llm.common import folded_words
from ledgermatch.llm.components import components


# -- Jaccard join

def brute_join(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = folded_words(t)
        n = min(5, len(w))
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else None)
    links, parent = Counter(), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12:
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [links[k] for k in range(len(rows))], [root(k) for k in range(len(rows))]


def near_copies(seed):
    rng = random.Random(seed)
    texts = [None, "", "one", "One!", "two words", "..."]
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(5000)}"
            texts.append(" ".join(own))
    shared = " ".join(f"s{k}" for k in range(40))
    texts += [shared + " " + " ".join(f"u{rng.randrange(9999)}" for _ in range(30)) for _ in range(10)]
    return texts + texts[6:9] + ["long " * 30_000]


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_join_equals_brute_force(spark, frame, block):
    texts = near_copies(1)
    order = list(range(len(texts)))
    random.Random(2).shuffle(order)
    texts = [texts[k] for k in order]
    links, classes = brute_join(list(enumerate(texts)))
    got = {r["doc_id"]: r for r in J.jaccard_join(spark, frame(texts, score=["x"] * len(texts)), block=block).collect()}
    assert [got[k]["n_links"] for k in range(len(texts))] == links
    assert [got[k]["class_id"] for k in range(len(texts))] == classes
    kept = J.one_of_each(spark, frame(texts, score=["x"] * len(texts)))
    assert kept.columns == ["doc_id", "text", "score"] and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(classes))


def test_jaccard_join_repeated_rows_and_missing_ids(spark):
    t = "a b c d e f g h i j"
    docs = spark.createDataFrame([(1, t), (1, t), (None, t), (2, "other words stand here alone now"), (None, None)],
                                 "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in J.jaccard_join(spark, docs).collect()), key=str)
    assert got == sorted([(1, 1, 2), (1, 1, 2), (None, 1, 2), (2, 2, 0), (None, None, 0)], key=str)
    kept = J.one_of_each(spark, docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "None", "None"]
    assert J.jaccard_join(spark, docs.limit(0)).count() == 0


def test_posterior_pruning():
    least = J.least_matches(0.8, 1e-6)
    rng = np.random.default_rng(3)
    for n, need in zip(range(16, 129, 16), least):  # integral of the posterior above the threshold, by a fine sum
        x = (np.arange(200_000) + 0.5) / 200_000
        for m, keeps in ((need, True), (need - 1, False)):
            if m < 0:
                continue
            log = m * np.log(x) + (n - m) * np.log1p(-x)
            p = np.exp(log - log.max())
            assert (p[x >= 0.8].sum() / p.sum() >= 1e-6) == keeps
    sig = rng.integers(0, 2 ** 16, (400, 128)).astype(np.uint16)
    sig[200:] = np.where(rng.random((200, 128)) < 0.8, sig[:200], sig[200:])
    a, b = J.prune(sig, np.arange(200), np.arange(200) + 200, least)
    assert len(a) == 200
    a, b = J.prune(sig, np.arange(199), np.arange(199) + 1, least)
    assert len(a) == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(4)
    own, (a, b) = rng.integers(0, 2 ** 63, 3000, dtype=np.uint64), J._permutations()
    x, y = J.signature(own[:2500], a, b).view(np.uint16), J.signature(own[500:], a, b).view(np.uint16)
    assert abs((x == y).mean() - 2000 / 3000) < 0.15


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["label"] for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


# -- shards

def test_matrix_has_exact_margins_and_means():
    counts, sizes = [5, 0, 17, 1, 30], H.shard_sizes(53, 4)
    total = np.zeros((5, 4))
    for seed in range(600):
        m = np.array(H.draw_matrix(counts, sizes, seed))
        assert m.sum(1).tolist() == counts and m.sum(0).tolist() == sizes and (m >= 0).all()
        total += m
    want = np.outer(counts, sizes) / 53
    assert np.abs(total / 600 - want).max() < 0.35


def test_hypergeometric_law():
    rng = np.random.default_rng(6)
    own = np.bincount([H.draw_one(rng, 7, 9, 6) for _ in range(20_000)], minlength=7) / 20_000
    from math import comb
    want = [comb(7, k) * comb(9, 6 - k) / comb(16, 6) for k in range(7)]
    assert np.abs(own - want).max() < 0.015
    big = [H.draw_one(rng, 6 * 10 ** 9, 10 ** 10, 10 ** 7) for _ in range(50)]
    assert abs(np.mean(big) / 3.75e6 - 1) < 0.001


def test_shards_are_exact_and_uniform(spark, frame):
    texts = [f"t{k % 50}" if k % 3 else None for k in range(203)]
    docs = frame(texts, source=[str(k) for k in range(203)])
    hits = np.zeros((203, 4))
    for seed in range(12):
        rows = H.shuffle_into_shards(spark, docs, 4, seed=seed, partitions=7, cell_rows=10).collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(203)) and all(r["source"] == str(r["doc_id"]) for r in rows)
        by = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(4)}
        assert [len(by[s]) for s in range(4)] == [51, 51, 51, 50] and all(v == list(range(len(v))) for v in by.values())
        for r in rows:
            hits[r["doc_id"], r["shard"]] += 1
    assert hits.max() < 12 and hits[:100].sum(0).min() > 200
    again = H.shuffle_into_shards(spark, docs.repartition(5), 4, seed=3, partitions=7)
    first = {(r["doc_id"], r["shard"], r["slot"]) for r in H.shuffle_into_shards(spark, docs, 4, seed=3, partitions=7).collect()}
    assert first == {(r["doc_id"], r["shard"], r["slot"]) for r in again.collect()}


def test_shards_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, None), (1, "a"), (1, "a"), (1, "a"), (2, "")], "doc_id long, text string") \
        .selectExpr("*", "'x' as shard")
    rows = H.shuffle_into_shards(spark, docs, 8).collect()
    assert sorted(r["shard"] for r in rows) == [0, 1, 2, 3, 4] and {r["slot"] for r in rows} == {0}
    assert H.shuffle_into_shards(spark, docs.limit(0), 8).count() == 0


def test_repeated_ids_keep_their_clean_texts(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(20)) for x in "abcd")
    docs = spark.createDataFrame([(3, b), (7, a), (7, b), (9, c), (9, d), (9, d), (None, c)], "doc_id long, text string")
    kept = sorted((str(r["doc_id"]), r["text"]) for r in J.one_of_each(spark, docs).collect())
    assert kept == sorted([("3", b), ("7", a), ("9", c), ("9", d), ("None", c)])


def test_texts_without_ids_keep_their_links(spark):
    base = [f"w{k}" for k in range(100)]
    near = base[:99] + ["other"]
    docs = spark.createDataFrame([(None, " ".join(base))] * 3 + [(5, " ".join(near)), (None, "alone " * 9), (None, None)],
                                 "doc_id long, text string")
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in J.jaccard_join(spark, docs).collect())
    assert got == Counter({(None, 5, 3): 3, (5, 5, 3): 1, (None, None, 0): 2})
