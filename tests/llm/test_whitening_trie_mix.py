import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from ledgermatch.llm import prefix_trie as P, source_mix as M, whitening as W

SPACES = " \t\n\v\f\r"


def n_words(text):
    for c in SPACES:
        text = text.replace(c, " ")
    return len(text.split(" ")) - text.split(" ").count("")


# -- whitening

def whitened(spark, rows, schema="vec_id long, embedding array<float>, n string, whitened string", **options):
    df = spark.createDataFrame(rows, schema)
    model = W.fit_whitening(spark, df, **options)
    return model, W.component_rows(W.whiten(spark, df, model, carry=["vec_id"]), model).collect()


def check_whitening(model, rows, vectors, components=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64).astype(object) + 1_000_000
    n, sums = len(x), x.sum(0)
    exact = n * x - sums
    a = (exact / n).astype(float)
    got = defaultdict(dict)
    for r in rows:
        got[r["vec_id"]][r["component"]] = r
    k = len(model.variances)
    w = np.array([[got[v][c + 1]["whitened"] for c in range(k)] for v in range(n)])
    assert all(set(g) == set(range(1, k + 1)) for g in got.values()) and len(got) == n
    assert [got[v][1]["deviation"] for v in range(n)] == [int(v) if v < 2 ** 63 else None for v in (exact * exact).sum(1)]
    assert {r["n"] for r in rows} == {n} and len({r["identity_error"] for r in rows}) == 1
    cov = w.T @ w / n - np.outer(w.mean(0), w.mean(0))
    assert np.abs(cov - np.eye(k)).max() < 1e-4 and rows[0]["identity_error"] < 1e-4
    v = model.components  # eigenvectors, by falling eigenvalue
    assert np.allclose(v.T @ v, np.eye(k), atol=1e-12) and (np.diff(model.variances) <= 0).all()
    assert np.allclose(w * np.sqrt(model.variances), a @ v, rtol=1e-9, atol=1e-9 * np.abs(a).max())
    sigma = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(model.explained, sigma[:k] ** 2 / (sigma ** 2).sum(), rtol=1e-4)
    return sigma


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((300, 40)) @ np.diag(np.linspace(3, 0.2, 40))
    rows = [(k, [float(c) for c in np.float32(v)], "x", "y") for k, v in enumerate(vectors)]
    bad = [(900, None, "x", "y"), (901, [1.0, None] + [0.0] * 38, "x", "y"), (902, [float("nan")] * 40, "x", "y"),
           (903, [float("-inf")] + [0.0] * 39, "x", "y"), (904, [1.0], "x", "y"), (905, [], "x", "y"), (906, [3e38] + [0.0] * 39, "x", "y")]
    model, got = whitened(spark, rows + bad)
    check_whitening(model, got, np.float32(vectors))
    assert model.n == 300 and len(model.variances) == 32


def test_whitening_of_ill_conditioned_and_dependent_columns(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((400, 6))
    scales = np.array([1e7, 1e4, 100, 10, 1, 0.3])
    vectors = np.round(base * scales * 64) / 64  # on the grid
    vectors = np.hstack([vectors, vectors[:, 2:4] * 2, np.ones((400, 2))])  # rank 6 of 10
    model, got = whitened(spark, [(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    sigma = check_whitening(model, got, vectors)
    assert len(model.variances) == 6 and sigma[6] < 1e-9 * sigma[0]
    hard = base @ np.linalg.qr(rng.standard_normal((6, 6)))[0] * np.array([2.0 ** 40, 2.0 ** 40, 1, 1, 1, 1])
    model, got = whitened(spark, [(k, v.tolist()) for k, v in enumerate(hard)], "vec_id long, embedding array<double>")
    assert len(model.variances) == 6 and got[0]["identity_error"] < 1e-4


def test_whitening_at_the_edges(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None), (2, [])], [(None, [])]):
        model, got = whitened(spark, rows, "vec_id long, embedding array<float>")
        assert got == [] and len(model.variances) == 0
    rows = [(None, [0.0, 1.0])] * 3 + [(2, [5.0, 1.0])] * 2 + [(3, [2.0, 7.0])]
    model, got = whitened(spark, rows, "vec_id long, embedding array<float>")
    assert len(got) == 12 and model.n == 6
    model = W.Whitening(10 ** 10, 1, [10 ** 16])  # numerators over 64 bits
    x = np.array([[10 ** 6], [10 ** 6 + 2 ** 40]])
    assert model.deviations(model.numerators(x)) == [0, None]
    assert model.centred(model.numerators(x))[1, 0] == 2.0 ** 40


# -- conversations

def rebuilt_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def trie_by_hand(built):
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        own = (len(m) - 1) * n_words(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own
    ends = defaultdict(list)
    for c, turns in built.items():
        ends[tuple(turns)].append(c)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def trie_rows(spark, rows, height=P.HEIGHT):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS depth", "'y' AS words")
    got = P.prefix_trie(*P.rebuilt(df), height=height).drop("x1", "x2").collect()
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in got)


def odd_conversations():
    rng = random.Random(4)
    rows, prompts = [], [[("user", f"prompt {k} " * k), ("assistant", f"answer\t{k}")] for k in range(4)]
    for c in range(130):
        turns = prompts[min(rng.randrange(7), 3)][:rng.randint(0, 2)] + [
            (rng.choice(["user", "assistant", None]), rng.choice([None, "", "yes", "no no", "word " * 50])) for _ in range(rng.randint(0, 6))]
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    shared = [(f"r{t % 2}", f"turn {t}") for t in range(75)]  # deep, and split at several depths
    for c, n in ((200, 75), (220, 75), (240, 48), (241, 32), (242, 33), (243, 31), (244, 16), (245, 17), (260, 70)):
        rows += [(c, t, *x) for t, x in enumerate(shared[:n])] + ([(c, 900, "user", f"own {c}")] if c % 3 else [])
    rows += [(300 + 20 * k, 0, "user", "the same") for k in range(700)] + [(301, None, "user", "null first"), (301, 3, "user", "b"),
             (301, 3, "user", "a"), (301, 3, "user", "a"), (None, 0, "user", "nobody's"), (7, None, None, None)]
    rows += [(20_001 + 20 * k + k % 19, 0, "user", "alone") for k in range(12)]  # the prompts' conversation is absent
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("height", [16, 2])
def test_prefix_trie_equals_brute_force(spark, height):
    rows = odd_conversations()
    want = trie_by_hand(rebuilt_by_hand(rows))
    assert any(w[1] == 0 and w[7] != hashlib.sha256(b"").hexdigest() for w in want)  # turnless conversations
    assert trie_rows(spark, rows, height) == want


def test_prefix_trie_across_runs_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "RUN", 8)
    monkeypatch.setattr(P, "END_RUN", 32)
    rows = odd_conversations() + [(900, t, "user", f"long {t % 3}") for t in range(700)]
    assert trie_rows(spark, rows, 4) == trie_by_hand(rebuilt_by_hand(rows))


def test_prefix_trie_at_the_edges(spark):
    assert trie_rows(spark, []) == [] and trie_rows(spark, [(None, 1, "a", "b")]) == []
    turnless = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    got = trie_rows(spark, [(turnless, 0, "user", "gone")])
    assert got == [(turnless, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
    with pytest.raises(ValueError):
        P.prefix_trie(None, None, height=3)


# -- mixing

def targets_by_hand(sizes, weights=(5, 2, 1)):
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    out, open_names, left = {}, set(names), Fraction(3 * sum(sizes.values()), 2)
    while open_names:
        level = left / sum(weight[n] for n in open_names)
        over = {n for n in open_names if level * weight[n] > 2 * sizes[n]}
        if not over:
            return out | {n: level * weight[n] for n in open_names}
        for n in over:
            out[n] = Fraction(2 * sizes[n])
            left -= out[n]
        open_names -= over
    return out


def odd_documents(seed, sources, docs):
    rng = random.Random(seed)
    rows = [(k, "word " * rng.choice([0, 1, 3, 40, 300]) + "x", rng.choice(sources)) for k in range(docs)]
    return rows + [(None, "a b c", None), (None, None, "s1"), (3, "", "s2"), (4, "same text", "s1"), (4, "same text", "s1"),
                   (9000, "w\tx\u00a0y\fz " * 4000, sources[0])]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_its_targets(spark, seed):
    sources = ["s1", "s2", "é", "Z", "a", None, "tiny", "s1", "s1", "s1"] if seed == 1 else [f"t{k}" for k in range(40)]
    rows = odd_documents(seed, sources, 700) + [(9100, "few words", "t"), (9101, None, "none at all")]
    docs = spark.createDataFrame([(*r, "old", "old") for r in rows], "doc_id long, text string, source string, target string, spans string")
    got = M.mix_sources(spark, docs, seed=seed, cell_rows=50, carry=["text", "target"]).collect()
    assert sorted((str(r["doc_id"]), str(r["text"]), str(r["source"])) for r in got) == sorted((str(a), str(b), str(c)) for a, b, c in rows)
    sizes = Counter({s: 0 for _, _, s in rows})
    for _, t, s in rows:
        sizes[s] += n_words(t or "")
    goals, taken = targets_by_hand(sizes), Counter()
    by_shard, blocks = Counter(), {s: -(-n // M.BLOCK) for s, n in sizes.items()}
    for r in got:
        assert r["size"] == n_words(r["text"] or "") and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(goals[r["source"]]), rel=1e-12)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(s["n_words"] for s in r["spans"])
        for copy in (0, 1):  # no word twice in a copy
            ends = sorted((s["first_word"], s["first_word"] + s["n_words"]) for s in r["spans"] if s["copy"] == copy)
            assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:])) and (not ends or ends[-1][1] <= r["size"])
        taken[r["source"]] += r["taken"]
        for s in r["spans"]:
            by_shard[s["shard"]] += s["n_words"]
    for s in sizes:
        assert abs(taken[s] - goals[s]) <= 3 * M.BLOCK and (goals[s] < 2 * sizes[s] or taken[s] == goals[s])
    whole = sum(taken.values())
    assert set(by_shard) <= set(range(M.SHARDS)) and max(by_shard.values()) - min(by_shard.values()) <= len(sizes) * M.BLOCK
    assert abs(whole - 1.5 * sum(sizes.values())) <= len(sizes) * M.BLOCK
    again = M.mix_sources(spark, docs.repartition(7), seed=seed, cell_rows=50, carry=["text", "target"])
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_quotas_are_the_highest_quotients(spark):
    rng = random.Random(6)
    for trial in range(4):
        sizes = {f"s{k:02d}": rng.choice([0, 1, 50, 64, 65, 1000, 40_000, 900_000]) for k in range(rng.choice([1, 7, 30]))}
        df = spark.createDataFrame([(n, v, 1) for n, v in sizes.items()], "source string, source_size long, n_rows long")
        for shards in (1, 5):
            rows = M.quotas(M.targets(df), shards=shards).orderBy("number").collect()
            seats = [r["target"] * r["n_blocks"] / r["source_size"] if r["source_size"] else 0.0 for r in rows]
            order = sorted((-s / (2 * k + 1), n) for n, s in enumerate(seats) if s for k in range(2 * rows[n]["n_blocks"]))
            house = round(sum(seats))
            for shard in range(shards):
                won = Counter(n for _, n in order[:house * (shard + 1) // shards])
                assert [r["ends"][shard] for r in rows] == [won[n] for n in range(len(rows))]


def test_mix_of_nothing_and_its_texts(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix_sources(spark, empty).count() == 0
    assert [r["taken"] for r in M.mix_sources(spark, spark.createDataFrame([(1, None, "a"), (2, " ", None)], empty.schema)).collect()] == [0, 0]
    rows = odd_documents(7, ["a", "b", "c"], 60)
    mixed = M.mix_sources(spark, spark.createDataFrame(rows, empty.schema), carry=["text"])
    M.write_mix(mixed, str(tmp_path / "mix"))
    written = spark.read.parquet(str(tmp_path / "mix")).collect()
    assert sum(n_words(r["text"]) for r in written) == sum(r["taken"] for r in mixed.collect())
    texts = defaultdict(str)
    for k, t, _ in rows:
        texts[k] += " ".join(t.split()) + " " if t and "\u00a0" not in t else " ".join((t or "").replace("\t", " ").replace("\f", " ").split(" ")) + " "
    assert all(r["text"] in texts[r["doc_id"]] for r in written)


def test_mix_stays_in_the_jvm(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    plan = M.mix_sources(spark, docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
