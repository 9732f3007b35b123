import hashlib
import random
import tempfile
import zlib
from array import array

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgermatch.llm.piece_codec import PieceCodec, transcode
from ledgermatch.llm.token_store import CutEncoder, digest_tokens, read_tokens, write_tokens

PIECES, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = list("abcdeorinst   \n\t▁.,!éñß中日😀\x00\x1c\x1f\x85\xa0  AB09<>|##") + [
    "  ", "the ", "ing", " \n ", "<s>", "</s>", "<0x0A>", "    ", "'s", "'ll", " the", "<|endoftext|>"]
EDGES = [None, "", " ", "\n", "a", "ab " * 20_000, "x" * 30_000, "▁", "same", "same", "héé  \n\n z"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def codec():
    with open(PIECES, "rb") as f:
        return PieceCodec(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_equal_the_library(codec, library):
    for t in odd_texts(4000, 1) + [t for t in EDGES if t]:
        ids = array("I", codec.encode(t)).tolist()
        assert ids == library.encode(t, add_bos=True, add_eos=True)
        assert codec.decode(ids) == library.decode(ids)


def test_backtracking_equals_merging(codec):
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("ehtrans▁") for _ in range(rng.randint(1, 60)))
        assert codec.backtrack(t) == codec.remerge(t)


def test_decode_of_any_ids(codec, library):
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(32_000) for _ in range(12)]
        assert codec.decode(ids) == library.decode(ids)


def test_transcode_edges(spark, frame, library):
    docs = frame(EDGES, n_words=["x"] * len(EDGES))
    got = {r["doc_id"]: r for r in transcode(spark, docs, PIECES, ("n_tokens", "input_ids", "ids_sha256", "decoded",
                                                                   "decoded_sha256")).collect()}
    assert len(got) == len(EDGES) and got[0]["n_words"] == "x"
    for k, t in enumerate(EDGES):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[k]["input_ids"] == ids and got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert got[k]["decoded"] == library.decode(ids)
        assert got[k]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert transcode(spark, docs.limit(0), PIECES).count() == 0


def test_cuts_equal_the_library():
    with open(BPE, encoding="utf-8") as f:
        own = CutEncoder(f.read())
    whole = Tokenizer.from_file(BPE)
    for t in odd_texts(4000, 4) + [t for t in EDGES if t]:
        assert array("I", own.encode(t)).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_token_store_round_trip(spark, frame):
    whole, path = Tokenizer.from_file(BPE), tempfile.mkdtemp() + "/tokens"
    docs = frame(EDGES, score=["x"] * len(EDGES)).repartition(3)
    write_tokens(spark, docs, BPE, path, end_id=2, partitions=4)
    want = {k: whole.encode(t or "", add_special_tokens=False).ids + [2] for k, t in enumerate(EDGES)}
    assert {r["doc_id"]: r["input_ids"] for r in read_tokens(spark, path).collect()} == want
    start = 0
    for r in digest_tokens(spark, path).orderBy("doc_id").collect():
        ids = want[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(array("I", ids).tobytes()))
        start += len(ids)
    assert {r["doc_id"] for r in read_tokens(spark, path, (2, 4)).collect()} == {2, 3, 4}
    plan = read_tokens(spark, path, (2, 4)).select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,2)" in plan and "input_ids" not in plan.split("ReadSchema")[-1]


def test_token_store_repeated_and_missing_ids(spark):
    path = tempfile.mkdtemp() + "/tokens"
    docs = spark.createDataFrame([(None, "a"), (1, "b c"), (1, "b c"), (1, "d")], "doc_id long, text string")
    write_tokens(spark, docs, BPE, path, end_id=2, partitions=2)
    rows = digest_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 1, 1]
    assert [r["start"] for r in rows] == [0, 2, *([5, 7] if rows[1]["n_tokens"] == 3 and rows[2]["n_tokens"] == 2 else
                                                 [5, 8] if rows[1]["n_tokens"] == 3 else [4, 7])]
    empty = tempfile.mkdtemp() + "/none"
    write_tokens(spark, docs.limit(0), BPE, empty, end_id=2)
    assert digest_tokens(spark, empty).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_token_store_splits_a_hot_id(spark, kind):
    path = tempfile.mkdtemp() + "/tokens"
    ids = [None] * 150 + [7] * 200 + list(range(40)) + [500] * 3
    cast = str if kind == "string" else int
    rows = [(None if d is None else cast(d), f"text {k}") for k, d in enumerate(ids)]
    write_tokens(spark, spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(5), BPE, path, end_id=2, partitions=8)
    stored = read_tokens(spark, path).collect()
    spread = {}
    for r in stored:
        spread.setdefault(r["doc_id"], set()).add(r["part"])
    assert len(spread[None]) > 1 and len(spread[cast(7)]) > 1
    order = [r["doc_id"] for r in digest_tokens(spark, path).orderBy("start").collect()]
    assert order == sorted((r[0] for r in rows), key=lambda v: (v is not None, v))
    whole = Tokenizer.from_file(BPE)
    assert sorted(r["input_ids"] for r in stored) == sorted(whole.encode(t, add_special_tokens=False).ids + [2] for _, t in rows)
