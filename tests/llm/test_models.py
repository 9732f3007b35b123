import random

import numpy as np
import pytest

from ledgermatch.llm import quality_knn as K, toxicity as T


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


# -- toxicity

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    terms = [("abcde", False), ("abd", False), ("bcdeabcdeab", False), ("ecba", True), ("aaaaa", False)]
    lexicon = T.FuzzyLexicon(terms)
    for _ in range(6000):
        w = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 13)))
        if rng.random() < 0.5:
            w = rng.choice(terms)[0]
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(w) + 1)
                w = w[:at] + rng.choice(["", "a", "z"]) + w[at + rng.randint(0, 1):]
        fits = [(edits(w, t), k) for k, (t, beginning) in enumerate(terms) if not beginning and edits(w, t) <= T.distance_for(t)]
        fits += [(0, k) for k, (t, beginning) in enumerate(terms) if beginning and w.startswith(t)]
        assert lexicon.find(w) == min(fits, default=None), w


def test_context_lowers_quotations():
    model = T.ToxicityModel([("moron", False)], frozenset(["oron"]), [-3.0, 3.0, 1.0, 1.0, 1.0])
    abuse, quote = model.features("you moron you moron"), model.features("he said “moron” and \"a moron\" too")
    assert abuse[0] > quote[0] > 0 and abuse[2] > quote[2]
    assert model.hits("the m0ron oron MORON!")[1] == [(1, 1, 1.0), (3, 0, 1.0)]
    assert model.score("you moron you moron") > model.score("he said “moron” and \"a moron\" too") > model.score("")
    assert model.score(None) == model.score("") == model.score("a fine day")


@pytest.fixture
def toxic_rows(spark):
    rng = random.Random(2)
    texts = [words(rng, 60) for _ in range(300)]
    bad = list(range(0, 300, 5))
    for k in bad:
        own = texts[k].split()
        for _ in range(4):
            own.insert(rng.randrange(len(own)), rng.choice(["scoundrel", "rotten", "vile" + rng.choice(["abc", "dd", "efg", "hha", "cab"])]))
        texts[k] = " ".join(own)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k in bad)) for k in range(300)] + [(None, 1), (7000, 1)], "doc_id long, toxic int")
    return docs, labels, set(bad)


def test_toxicity_is_learned(spark, frame, toxic_rows):
    docs, labels, bad = toxic_rows
    model = T.fit(spark, docs, labels)
    assert ("scoundrel", False) in model.terms and any(b and t.startswith("vile") for t, b in model.terms)
    found = {r["doc_id"]: r for r in T.score_toxicity(spark, docs, model).collect()}
    assert {k for k, r in found.items() if r["predicted"]} == bad
    odd = T.score_toxicity(spark, frame([None, "", "you scoundrle rotten " * 2000, "x", "x"], score=["old"] * 5), model)
    assert [r["predicted"] for r in odd.orderBy("doc_id").collect()] == [0, 0, 1, 0, 0]
    assert T.keep_civil(spark, docs, model).count() == 240 and T.keep_civil(spark, docs, model).columns == docs.columns
    empty = T.fit(spark, docs, labels.where("toxic = 0"))
    assert {r["score"] for r in T.score_toxicity(spark, docs, empty).collect()} == {0.0}
    assert T.score_toxicity(spark, docs.limit(0), model).count() == 0


def test_inflected_words_keep_their_errors(spark):
    rng = random.Random(12)
    forms = ["scoundrel", "scoundrels", "scoundrelly", "scoundreling", "scoundreled", "scoundreldom"]
    texts = [words(rng, 40) + (" " + " ".join(rng.sample(forms, 4)) if k % 4 == 0 else "") for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    model = T.fit(spark, docs, labels)
    assert any(b and "scoundrel".startswith(t) for t, b in model.terms) and {(w, False) for w in forms} <= set(model.terms)
    for w in ("scaundrel", "zcoundrel", "s0oundrels", "coundrelly", "sccoundreling"):
        assert model.match(w), w
        assert model.score("you " + w + " a b c d e f " + w) > model.score("you a b c d e f")
    assert model.match("scoundrelish")[0] == 0


def test_rare_and_short_terms_are_learned(spark):
    rng = random.Random(13)
    texts, toxic = [words(rng, 12) for _ in range(6000)], set(range(0, 6000, 10))
    learn = [r["doc_id"] for r in spark.range(6000).withColumnRenamed("id", "doc_id").where(T.training_fold()).orderBy("doc_id").collect()]
    bad = [k for k in learn if k in toxic]
    rare = ["zounds", "xi", "傻瓜", "k1ll", "ไอ้โง่", "f*ck"]
    for n, w in enumerate(rare):  # five texts of about 480 each
        for k in bad[5 * n:5 * n + 5]:
            texts[k] += " " + w
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k in toxic)) for k in range(6000)], "doc_id long, toxic int")
    model = T.fit(spark, docs, labels)
    assert {w for w, b in model.terms if not b} == set(rare)
    assert model.match("zoundz")[0] == 1 and model.match("xi!") and not model.match("xa") and not model.match("k2ll")


def test_evidence_of_columns_equals_plain_sums(spark):
    rows = [("t", False, a, b) for a in (0, 1, 4, 5, 9, 40, 100) for b in (0, 1, 2, 30, 900)]
    got = {(r["a"], r["b"]) for r in T.proven(spark.createDataFrame(rows, "term string, beginning boolean, a long, b long"), 100, 900).collect()}
    want = set()
    for _, _, a, b in rows:
        p, total = (a + b) / 1000, 0.0
        for x, q in ((a, 100 * p), (100 - a, 100 * (1 - p)), (b, 900 * p), (900 - b, 900 * (1 - p))):
            total += 2 * x * np.log(x / q) if x else 0.0
        if total >= 20 and (a + 0.5) / 101 >= 10 * (b + 0.5) / 901:
            want.add((a, b))
    assert got == want and (5, 0) in got and (4, 0) not in got


# -- quality

def test_neighbours_vote(spark, frame):
    rng = random.Random(3)
    texts = [words(rng, 50) for _ in range(200)]
    bad = set(range(0, 200, 4))
    for k in bad:
        texts[k] = " ".join(w.upper() + "##" for w in texts[k].split()) if k % 8 else (texts[k][:9] + " ") * 30
    docs = frame(texts, score=["old"] * 200)
    labels = spark.createDataFrame([(k, int(k not in bad)) for k in range(200)] + [(None, 0)], "doc_id long, quality int")
    model = K.fit(docs, labels)
    found = {r["doc_id"]: r for r in K.score_quality(spark, docs, model).collect()}
    assert {k for k, r in found.items() if not r["predicted"]} == bad
    assert K.keep_good(spark, docs, model).count() == 150
    odd = K.score_quality(spark, frame([None, "", "z" * 200_000, "a b", "a b"]), model).orderBy("doc_id").collect()
    assert all(0 <= r["score"] <= 1 for r in odd) and odd[0]["score"] == odd[1]["score"] == pytest.approx(model.prior)
    nothing = K.fit(docs, labels.limit(0))
    assert {r["score"] for r in K.score_quality(spark, docs, nothing).collect()} == {0.5}
    assert K.score_quality(spark, docs.limit(0), model).count() == 0


def test_blocked_products_equal_plain_cosines():
    rng = random.Random(4)
    texts = [words(rng, rng.randint(1, 60)) for _ in range(90)]
    terms = K.Terms()
    model = K.NeighbourModel([terms.counts(t) for t in texts], [rng.randint(0, 1) for _ in texts])
    got = model.scores(texts[:20])
    for t, score in zip(texts[:20], got):
        row = K._unit(K._unit(K._matrix([terms.counts(t)]) * model.idf) @ model.projection)[0]
        near = model.vectors @ row
        order = np.sort(np.round(near, 5))[::-1]
        last, vote, total = order[K.K - 1], 0.0, 0.0
        left = K.K - (order > last).sum()
        for cosine, label in zip(np.round(near, 5), model.labels):
            if cosine >= last:
                weight = (cosine ** 8 + 1e-6) * (1 if cosine > last else left / (order == last).sum())
                vote, total = vote + weight * label, total + weight
        assert score == pytest.approx(vote / total, abs=1e-3)


def test_whole_tokens_and_vocabulary_count():
    rng = random.Random(14)

    def bag(text):
        return K.Terms().counts(text)

    start = "汉字" * 40  # 240 bytes; then one token to its end
    for a, b in ((start + "好人" * 500, start + "坏蛋" * 500), ("x" * 70 + "|AB9#c" * 300, "x" * 70 + "|ab#C9" * 300),
                 ("Ab1#Cd2$Ef3%Gh4&", "Ab1#Cd2$Ef3%99..")):
        assert bag(a) != bag(b)
    short, long = bag("Ab1#" * 16), bag("Ab1#" * 1600)
    assert max(long[b] for b in long if b < K.SHAPE_BUCKETS) > max(short[b] for b in short if b < K.SHAPE_BUCKETS)
    assert K._shapes(b"aaaBBBB11#") == [b"aaAA99#"] and b"".join(K._shapes(b"aB1#" * 16)) == b"aA9#" * 16
    pool = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(80)})
    good, bad = pool[::2], pool[1::2]  # alike in shape
    for blank in (" ", ""):  # words, and one token without blanks
        texts = [blank.join(rng.choice(bad if k % 2 else good) for _ in range(60)) for k in range(120)]
        model = K.NeighbourModel([bag(t) for t in texts[:80]], [1 - k % 2 for k in range(80)])
        assert ((model.scores(texts[80:]) >= 0.5) == [k % 2 == 0 for k in range(80, 120)]).all()


def test_repeated_ids_do_not_fill_the_sample(spark):
    from ledgermatch.llm import quality_rules as R
    from ledgermatch.llm.common import labelled_texts
    docs = spark.createDataFrame([(1, f"text number {k} " * 30) for k in range(500)] + [(2, "b"), (2, None), (3, None), (None, "n")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (1, 0, 1), (2, 0, 0), (3, 1, 1), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, labelled_texts(docs, labels, "quality", 10).collect()))
    assert got == [(1, 0, "text number 0 " * 30), (1, 1, "text number 0 " * 30), (2, 0, "b"), (3, 1, None)]
    assert labelled_texts(docs, labels, "quality", 2).count() <= 2
    assert R.labelled_stats(docs, labels, most=2).count() <= 2
    assert len(K.fit(docs, labels, most=2).labels) <= 2
    nulls = spark.createDataFrame([(None,)], "doc_id long").select(K.training_fold().alias("k"), T.training_fold().alias("t"))
    assert tuple(nulls.first()) == (False, False)


def test_subspace_iteration_equals_the_singular_vectors():
    x = np.random.default_rng(3).standard_normal((300, 80)).astype(np.float32) * np.linspace(9, 1, 80, dtype=np.float32) ** 2
    want = np.linalg.svd(x.astype(np.float64), full_matrices=False)[2][:10]
    got = K._leading(x, 10, rounds=40)
    assert np.allclose(np.abs((want * got.T).sum(1)), 1, atol=1e-3)


def test_long_tokens_stay_out_of_the_memos():
    from ledgermatch.llm.jaccard_join import WordHashes
    model, hashes = T.ToxicityModel([("scoundrel", False)]), WordHashes()
    for k in range(50):
        model.hits(f"{k}" + "x" * 5000)
        hashes[b"%d" % k + b"y" * 5000]
    assert not model.memo and not model.memo.fresh and not hashes
