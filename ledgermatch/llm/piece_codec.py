"""SentencePiece (merge type) encoding by exact backtracking, and decoding.

A merge-type encoder joins, again and again, the adjacent pair whose joined piece scores best (leftmost first among
equals). Its result is the only split of the text into pieces whose adjacent pairs all stay as they are when their
joined text is merged afresh. So it can be found from the left: an Aho-Corasick automaton lists the pieces that start
at each position, the longest one compatible with its left neighbour is taken, and when none fits the position is
marked in a bitfield of failed positions and the previous piece gives way to its next shorter one. A prefix has one
split only, so a failed position never needs a second visit and the work stays linear in the text.

Text is cut where no piece can cross: before a blank mark that follows another character (checked against the
vocabulary when the model is loaded) and around line breaks that no piece holds. Cuts repeat a lot, so their ids are
kept in a bounded memo for each worker.

Results at the edges: null and empty texts give only the begin and end ids and decode to ''. Characters outside the
vocabulary become their UTF-8 byte pieces. Rows are handled one by one: ties, repeated rows and clashing extra columns
have no effect (columns named like an output are replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from .common import Memo, Shipped, append_columns

MARK = "▁"  # stands for a blank inside pieces
MEMO_LIMIT = 400_000  # cuts whose ids a worker keeps, see Memo
PAIR_LIMIT = 400_000  # pairs whose compatibility a worker keeps


class PieceCodec:
    """Encoder and decoder of one merge-type model file; pickles as the file's bytes."""

    def __init__(self, model: bytes):
        self.model = model
        self._load()

    def __getstate__(self):
        return {"model": self.model}

    def __setstate__(self, state):
        self.__init__(state["model"])

    def _load(self):
        from sentencepiece import sentencepiece_model_pb2
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.model)
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != train.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces \
                or not norm.add_dummy_prefix or not norm.escape_whitespaces or train.treat_whitespace_as_suffix \
                or not train.byte_fallback or any(p.type == 4 for p in proto.pieces):
            raise ValueError("only merge-type models with byte fallback, a leading blank and no text normalisation")
        self.scores, self.pieces, self.bytes_of, self.bos, self.eos = {}, {}, {}, 1, 2
        self.plain: list[bytes] = []  # what each id decodes to
        self.kind: list[int] = []
        for i, p in enumerate(proto.pieces):
            self.kind.append(p.type)
            if p.type == 6:
                self.bytes_of[int(p.piece[3:5], 16)] = i
                self.plain.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == 1:
                self.pieces[p.piece], self.scores[p.piece] = i, p.score
                self.plain.append(p.piece.replace(MARK, " ").encode())
            else:
                self.plain.append(" ⁇ ".encode() if p.type == 2 else b"")
                if p.piece == "<s>":
                    self.bos = i
                if p.piece == "</s>":
                    self.eos = i
        self.by_id = {i: p for p, i in self.pieces.items()}
        self.known = {p for p in self.pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.pieces.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        #: whether no piece holds a mark after another character, or a line break
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        self.lines = not any("\n" in p for p in self.pieces)
        self.runs = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.pairs: dict = {}
        self.memo = Memo(self.encode_run, MEMO_LIMIT)

    # -- encoding

    def remerge(self, text: str) -> list[int]:
        """The merge procedure itself, on a short text of known characters."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.pieces[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces (left is -1 at a start) stay as they are when their text is merged afresh."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIR_LIMIT:
                self.pairs.clear()
            text = self.by_id[right] if left < 0 else self.by_id[left] + self.by_id[right]
            known = self.pairs[key] = self.remerge(text) == ([right] if left < 0 else [left, right])
        return known

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text of known characters only."""
        n = len(text)
        starts: list[list] = [[] for _ in range(n)]
        for end, hit in self.automaton.iter(text):
            starts[end - hit[1] + 1].append(hit)  # shorter pieces end, and so come, first
        failed = bytearray(n // 8 + 1)
        pairs, ids, trail, at, k = self.pairs, [], [], 0, len(starts[0]) - 1
        while at < n:
            here, left = starts[at], ids[-1] if ids else -1
            while k >= 0:
                i, size = here[k]
                end = at + size
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = pairs.get((left, i))
                    if self.compatible(left, i) if fits is None else fits:
                        break
                k -= 1
            if k >= 0:
                ids.append(i)
                trail.append((at, k))
                at = end
                k = len(starts[at]) - 1 if at < n else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at, k = trail.pop()
                ids.pop()
                k -= 1
        return ids

    def encode_run(self, run: str) -> bytes:
        """Ids of one cut as little-endian 32-bit integers; unknown characters become bytes and merge with nothing."""
        if not run:
            return b""
        out = array("I")
        if self.known.issuperset(run):
            out.extend(self.backtrack(run))
        else:
            for known, part in _spans(run, self.known):
                if known:
                    out.extend(self.backtrack(part))
                else:
                    out.extend(self.bytes_of[b] for b in part.encode("utf-8", "replace"))
        return out.tobytes()

    def cut(self, text: str) -> list[str]:
        if not self.cuts:
            return [MARK + text.replace(" ", MARK)]
        if self.lines and "  " not in text and MARK not in text and text[0] != " ":
            return (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")
        return self.runs.findall(MARK + text.replace(" ", MARK))

    def encode(self, text: str | None) -> bytes:
        """All ids with the begin and end ids, as little-endian 32-bit integers."""
        if not text:
            return array("I", (self.bos, self.eos)).tobytes()
        runs = map(self.memo.__getitem__, self.cut(text))
        return array("I", (self.bos,)).tobytes() + b"".join(runs) + array("I", (self.eos,)).tobytes()

    # -- decoding

    def decode(self, ids: Sequence[int]) -> str:
        """The text of the ids: control ids vanish, byte pieces join to characters, one leading blank goes."""
        data = b"".join(map(self.plain.__getitem__, ids))
        for i in ids:
            if self.kind[i] != 3:
                if self.kind[i] == 1 and data[:1] == b" ":
                    data = data[1:]
                break
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:  # each byte that starts no character becomes U+FFFD
            return _lenient(data)


def _lenient(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at:at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _spans(text: str, known: set):
    start = 0
    for k in range(1, len(text) + 1):
        if k == len(text) or (text[k] in known) != (text[start] in known):
            yield text[start] in known, text[start:k]
            start = k


FIELDS = {
    "input_ids": StructField("input_ids", ArrayType(IntegerType(), False)),
    "n_tokens": StructField("n_tokens", LongType()),
    "ids_sha256": StructField("ids_sha256", StringType()),
    "decoded": StructField("decoded", StringType()),
    "decoded_sha256": StructField("decoded_sha256", StringType()),
}


def transcode(spark: SparkSession, docs: DataFrame, model_path: str,
              outputs: Sequence[str] = ("input_ids", "n_tokens", "decoded"), carry: Sequence[str] | None = None,
              text: str = "text") -> DataFrame:
    """Encode every whole text (begin and end ids included) and decode the ids again.

    ``outputs`` picks from FIELDS: the ids, their count, the decoded text, and SHA-256 digests of both (ids as
    little-endian unsigned 32-bit integers, text as UTF-8). ``carry``: input columns to keep (default all).
    """
    with open(model_path, "rb") as f:
        codec = Shipped(spark, PieceCodec(f.read()))
    outputs = list(outputs)

    def work(texts):
        own = codec.get()
        made = {name: [] for name in outputs}
        for t in texts:
            data = own.encode(t)
            if "n_tokens" in made:
                made["n_tokens"].append(len(data) // 4)
            if "input_ids" in made:
                made["input_ids"].append(data)
            if "ids_sha256" in made:
                made["ids_sha256"].append(hashlib.sha256(data).hexdigest())
            if "decoded" in made or "decoded_sha256" in made:
                back = own.decode(array("I", data))
                if "decoded" in made:
                    made["decoded"].append(back)
                if "decoded_sha256" in made:
                    made["decoded_sha256"].append(hashlib.sha256(back.encode("utf-8")).hexdigest())
        return [_ids_array(v) if k == "input_ids" else pa.array(v, pa.int64() if k == "n_tokens" else pa.string())
                for k, v in made.items()]

    return append_columns(docs, work, [FIELDS[name] for name in outputs], carry, text)


def _ids_array(parts: list[bytes]) -> pa.ListArray:
    """A list column over the ids' bytes as they are."""
    ends, total = array("i", [0]), 0
    for p in parts:
        total += len(p) // 4
        ends.append(total)
    values = pa.Array.from_buffers(pa.int32(), total, [None, pa.py_buffer(b"".join(parts))])
    offsets = pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends.tobytes())])
    return pa.ListArray.from_arrays(offsets, values)
