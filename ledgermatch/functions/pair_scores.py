"""Scores of the pairs of two blocks of rows (P8, P9, F15, F16, F17), as an Arrow UDF.

A row holds a block of invoices and a block of transactions as arrays. Its
pairs are tested and scored in Numpy, at most some 2^20 at a time whatever the rows
hold, so they are never rows of a shuffle or a sort. A score is the one of
``similarity`` (a blank number scores 0) plus the bonus for equal amounts.
"""

from __future__ import annotations

import sys
from typing import Iterator, Tuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from .similarity import partial_ratio_py

#: The day of an invoice without a date.
UNDATED = -(1 << 40)
_TESTED = 1 << 20  # pairs of the rows worked on at a time
_CELLS = 1 << 19  # cells of the distance tables worked on at a time


def _codes(texts: pa.Array):
    """Code points of all texts one after the other, where each text starts, its length."""
    texts = texts.fill_null("")
    whole = pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts), "")[0].as_py() or ""
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    top = int(codes.max()) if len(codes) else 0
    codes = codes.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, np.cumsum(lengths) - lengths, lengths


def levenshtein_pairs(a: pa.Array, b: pa.Array, left, right):
    """Levenshtein distance of ``a[left[k]]`` and ``b[right[k]]`` for every k,
    and the longer one's length. The table holds what aligning saves against
    writing both texts: 2 for an equal letter, 1 for another one."""
    (ca, at_a, len_a), (cb, at_b, len_b) = _codes(a), _codes(b)
    la_all, lb_all = len_a[left], len_b[right]
    out = np.empty(len(left), np.int64)
    step = max(64, _CELLS // (1 + int(la_all.max(initial=0))))
    for s in range(0, len(left), step):
        la, lb = la_all[s:s + step], lb_all[s:s + step]
        o = np.argsort(-(lb.astype(np.int16) if lb.max() < 1 << 15 else lb), kind="stable")  # texts that end leave the table
        la, lb, l, r = la[o], lb[o], at_a[left[s:s + step][o]], at_b[right[s:s + step][o]]
        rows, longest = int(la.max()), int(lb[0])
        size = np.uint8 if rows + longest < 250 else np.uint16 if rows + longest < 65_000 else np.int64
        letters = np.empty((rows, len(l)), ca.dtype)
        for i in range(rows):
            letters[i] = ca[np.minimum(l + i, len(ca) - 1)]
        saved = np.zeros((rows + 1, len(l)), size)
        ends = np.searchsorted(-lb, -np.arange(longest), side="left")  # texts longer than j
        for j in range(longest):
            n = int(ends[j])
            more = np.equal(letters[:, :n], cb[r[:n] + j]).view(np.uint8) + saved[:-1, :n]
            more += size(1)
            np.maximum(more, saved[1:, :n], out=more)
            for i in range(rows):
                np.maximum(more[i], saved[i, :n], out=saved[i + 1, :n])
        out[s + o] = la + lb - saved[la, np.arange(len(l))]
    return out, np.maximum(la_all, lb_all)


def _text_scores(scorer: str, a: pa.Array, b: pa.Array, left, right):
    """Similarity x 100 of the pairs; ``a`` is null for a blank number."""
    out = np.zeros(len(left))
    some = np.flatnonzero(a.is_valid().to_numpy(zero_copy_only=False)[left])
    left, right = left[some], right[some]
    if scorer == "partial_ratio":
        x, y, memo = a.to_pylist(), b.to_pylist(), {}
        for k, i, j in zip(some, left, right):
            pair = x[i], y[j]
            if pair not in memo:
                memo[pair] = partial_ratio_py(*pair) if pair[1] else 0.0
            out[k] = memo[pair]
    elif len(some):
        far, longest = levenshtein_pairs(a, b, left, right)
        out[some] = 100.0 * (1.0 - far / longest)
    return out


def _flat(lists: pa.Array):
    """The lists' values, where each list starts and its length (0 for null)."""
    lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten(), np.cumsum(lengths) - lengths, lengths


def _numbers(values: pa.Array):
    return values.to_numpy(zero_copy_only=False)


def _lists(lengths, **fields) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _scored(lists, scorer: str, tol: int, max_days: int, bonus: float):
    """The pairs of some rows that pass the tests: row, places in its blocks,
    place among all invoices, and score; then the rows' numbers of invoices."""
    (day, at_i, n_i), (t_day, at_t, n_t) = _flat(lists[0]), _flat(lists[3])
    cents, t_cents = _numbers(lists[1].flatten()), _numbers(lists[4].flatten())
    day, t_day, rows = _numbers(day), _numbers(t_day), np.arange(len(n_i))
    own, t_own = np.repeat(rows, n_i), np.repeat(rows, n_t)
    # an invoice's band is a range of its row's transactions in the order of amounts
    steps, place = np.unique(np.concatenate([t_cents, cents - tol, cents + tol]), return_inverse=True)
    t_place, least, most = np.split(place, [len(t_cents), len(t_cents) + len(cents)])
    order = np.lexsort((t_place, t_own))
    key = (t_own * len(steps) + t_place)[order]
    begin = np.searchsorted(key, own * len(steps) + least, "left")
    count = np.searchsorted(key, own * len(steps) + most, "right") - begin
    left = np.repeat(np.arange(len(cents)), count)
    right = order[np.arange(len(left)) + np.repeat(begin - (np.cumsum(count) - count), count)]
    gap = t_day[right] - day[left]
    keep = np.flatnonzero((day[left] == UNDATED) | ((gap >= 0) & (gap <= max_days)))
    left, right = left[keep], right[keep]
    row = own[left]
    score = _text_scores(scorer, lists[2].flatten(), lists[5].flatten(), left, right) \
        + np.where(cents[left] == t_cents[right], bonus, 0.0)
    return row, left - at_i[row], right - at_t[row], left, right, score, n_i


def _all_pairs(lists, *rule) -> pa.Array:
    row, i, t, _, _, score, n_i = _scored(lists, *rule)
    return _lists(np.bincount(row, minlength=len(n_i)), i=pa.array(i.astype(np.int32)), t=pa.array(t.astype(np.int32)),
                  score=pa.array(score))


def _best_pairs(lists, *rule) -> pa.Array:
    """For each invoice its best transaction, the first one of equal scores."""
    _, _, t, left, right, score, n_i = _scored(lists, *rule)
    place, top, found = np.full(n_i.sum(), -1, np.int32), np.zeros(n_i.sum()), np.zeros(n_i.sum(), np.int64)
    if len(left):
        begins = np.flatnonzero(np.diff(left, prepend=-1))
        who, best = left[begins], np.maximum.reduceat(score, begins)
        top[who], found[who] = best, np.add.reduceat(_numbers(lists[6].flatten())[right], begins)
        hits = np.flatnonzero(score == top[left])
        begins = np.flatnonzero(np.diff(left[hits], prepend=-1))
        place[who] = np.minimum.reduceat(t[hits], begins)
    none = place < 0
    return _lists(n_i, t=pa.array(place, mask=none), score=pa.array(top, mask=none), n=pa.array(found))


def pair_scores(columns: list[Column], scorer: str, tol: int, max_days: int, bonus: float, best: bool) -> Column:
    """``columns``: day, absolute cents and lower-case number of the invoices,
    day, absolute cents and lower-case text of the transactions (and their
    copies), as arrays. All pairs ``(i, t, score)`` that pass the tests, or
    with ``best`` one ``(t, score, n)`` for each invoice."""
    if scorer not in ("levenshtein", "partial_ratio"):
        raise ValueError(f"unknown scorer {scorer!r}")
    made = _best_pairs if best else _all_pairs

    def scored(batches: Iterator[Tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for lists in batches:
            pairs = _flat(lists[0])[2] * np.maximum(1, _flat(lists[3])[2])
            part = np.cumsum(pairs) // _TESTED
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield made([x.slice(a, b - a) for x in lists], scorer, tol, max_days, bonus)

    scored.__annotations__ = {"batches": Iterator[Tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    kind = "array<struct<t:int,score:double,n:bigint>>" if best else "array<struct<i:int,t:int,score:double>>"
    return F.arrow_udf(scored, kind)(*columns)


# Ship this module's code with the UDF, as similarity.py does.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
