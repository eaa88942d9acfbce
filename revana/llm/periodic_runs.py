"""Periodic runs of words by string synchronising sets.

A run is a maximal stretch of words with smallest period q and at least
``EXPONENT`` * q words. Periods below ``FIRST`` are found by comparing the words
with themselves shifted. For the others, scale t = FIRST, 2 FIRST, 4 FIRST, ...
finds the periods from t to 2t - 1:

* Every stretch of t words gets a name; two have the same name only if they are
  equal. Stretches of period t / EXPONENT or less lie in the runs found so far;
  these highly periodic regions take no part, their periods are known.
* A position is in the synchronising set if, of the t + 1 stretches that start in
  the t words after it or at either end, the one with the smallest hash starts
  at the first or the last. That depends on the 2t words from it alone, so equal
  contexts are selected alike, and wherever the text is not highly periodic one
  of t consecutive positions is selected.
* A run of period q in [t, 2t) has a selected position in its first t words,
  another one q words on with the same 2t words, and none with them between.
  So each selected position and the next one with an equal context propose their
  distance as a period, which is then extended word by word as far as it holds.
  A proposal has no smaller period, or its context would recur earlier.

The words are compared themselves, never by hash alone. All documents of a slice
are worked on together; each ends with a word of its own, which no stretch
repeats. A scale goes on with the documents of at least EXPONENT * t words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from revana.llm.common import field, mix, slices

EXPONENT = 4
SHORTEST = 6            # words of a run
FIRST = 4               # first scale; smaller periods are compared directly
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _shifted_runs(ids: np.ndarray, period: int) -> np.ndarray:
    """Rows (start, end, period) of the runs of a small period."""
    if len(ids) <= period:
        return np.zeros((0, 3), np.int64)
    same = np.zeros(len(ids) - period + 2, np.int8)
    same[1:-1] = ids[:-period] == ids[period:]
    edges = np.flatnonzero(np.diff(same))
    start, end = edges[::2], edges[1::2] + period
    keep = end - start >= EXPONENT * period
    for smaller in (d for d in range(1, period) if period % d == 0):
        at = start[keep][:, None] + np.arange(period)
        keep[keep] = (ids[at] != ids[at + smaller]).any(axis=1)
    return np.stack([start[keep], end[keep], np.full(keep.sum(), period)], axis=1)


def _doubled(names: np.ndarray, t: int) -> np.ndarray:
    """Names of the stretches of 2t words from names of those of t words."""
    top = int(names.max()) + 1
    after = np.concatenate([names[t:], top + np.arange(min(t, len(names)))])
    return np.unique(names * (top + t) + after, return_inverse=True)[1].astype(np.int64)


def _covered(runs: np.ndarray, n: int, t: int) -> np.ndarray:
    """Positions whose t words have period t / EXPONENT or less."""
    change = np.zeros(n + 1, np.int64)
    known = runs[(runs[:, 2] * EXPONENT <= t) & (runs[:, 1] - runs[:, 0] >= t)]
    np.add.at(change, known[:, 0], 1)
    np.add.at(change, known[:, 1] - t + 1, -1)
    return np.cumsum(change[:n]) > 0


def synchronising_set(names: np.ndarray, t: int, periodic: np.ndarray) -> np.ndarray:
    """Selected positions. ``names`` are those of stretches of t words."""
    order = mix(names.astype(np.uint64) + np.uint64(t << 40))
    order[periodic] = _LAST
    beyond = np.full(t, _LAST)
    least, width = order, 1
    while width < t:
        least = np.minimum(least, np.concatenate([least[width:], beyond[:width]])[:len(order)])
        width *= 2
    last = np.concatenate([order[t:], beyond])[:len(order)]
    least = np.minimum(least, last)
    return np.flatnonzero((least != _LAST) & ((order == least) | (last == least)))


def _agreeing(ids: np.ndarray, at: int, period: int, step: int) -> int:
    """How many words from ``at`` on, going by ``step`` (1 or -1), equal the word
    ``period`` before (after, going back)."""
    n, size = 0, 16
    while True:
        if step > 0:
            a, b = ids[at + n:at + n + size], ids[at + n - period:at + n - period + size]
            b = b[:len(a)]
        else:
            stop = max(at - n + 1, 0)
            low = max(stop - size, 0)
            a, b = ids[low:stop][::-1], ids[low + period:stop + period][::-1]
        differs = np.flatnonzero(a != b)
        if len(differs):
            return n + int(differs[0])
        n += len(a)
        if len(a) < size:
            return n
        size *= 2


def _proposed_runs(ids: np.ndarray, selected: np.ndarray, contexts: np.ndarray, t: int) -> np.ndarray:
    """Rows (start, end, period) of the runs that neighbours with equal contexts of
    2t words propose, periods in [t, 2t)."""
    by = selected[np.argsort(contexts, kind="stable")]
    sorted_ = np.sort(contexts, kind="stable")
    period = by[1:] - by[:-1]
    fits = (sorted_[1:] == sorted_[:-1]) & (period >= t) & (period < 2 * t)
    at, period = by[:-1][fits], period[fits]
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    # Proposals of one period that overlap by it are one stretch.
    fresh = np.ones(len(at), bool)
    fresh[1:] = (period[1:] != period[:-1]) | (at[1:] - at[:-1] > 2 * t)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    found, end, known = [], -1, 0
    for p, low, high in zip(period[first].tolist(), at[first].tolist(), (at[last] + period[last] + 2 * t if len(at) else at).tolist()):
        if p == known and high <= end:          # lies in the run just found
            continue
        start = low - _agreeing(ids, low - 1, p, -1)
        end, known = high + _agreeing(ids, high, p, 1), p
        if end - start >= EXPONENT * p:
            found.append((start, end, p))
    return np.array(found, np.int64).reshape(-1, 3)


def runs_of(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs, exponent ``EXPONENT`` or more.

    ``ids`` are the words of all documents, ``lengths`` their numbers of words
    with the last one of each, which must occur nowhere else.
    """
    place = np.arange(len(ids))                     # of the words that go on
    found = [_shifted_runs(ids, p) for p in range(1, FIRST)]
    names, own = ids.astype(np.int64), ids
    for t in (1 << k for k in range(FIRST.bit_length() - 1)):
        names = _doubled(names, t) if len(names) else names
    t = FIRST
    while True:
        stays = lengths > EXPONENT * t
        if not stays.any():
            break
        kept = np.repeat(stays, lengths)
        names, place, own, lengths = names[kept], place[kept], own[kept], lengths[stays]
        known = np.concatenate(found)
        known = known[np.isin(known[:, 0], place)]
        # ``place`` is made of whole documents, so a run moves as a whole.
        moved = np.searchsorted(place, known[:, 0])
        here = np.stack([moved, moved + known[:, 1] - known[:, 0], known[:, 2]], axis=1)
        selected = synchronising_set(names, t, _covered(here, len(names), t))
        names = _doubled(names, t)
        runs = _proposed_runs(own, selected, names[selected], t)
        if len(runs):
            start = place[runs[:, 0]]
            found.append(np.stack([start, start + runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1))
        t *= 2
    return np.concatenate(found)


def collapse_runs(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, runs, collapsed) per row of ``docs``.

    Words are what white space (blank, \\t, \\n, \\x0B, \\f, \\r) separates. ``runs``
    holds (start, length, period) in words by start, then period, of every run of
    at least ``SHORTEST`` words; none overlaps the end of a text. ``collapsed`` is the text with only
    the first period of each run left, its words joined by one blank.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``.
    Rows that repeat, and rows with a null id, each get a row; an empty table
    gives an empty one; columns other than ``id_col`` and ``text`` are ignored. A
    text is worked on whole, whatever its length, in memory in proportion to it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [(t or "").encode().split() for t in field(batch, "text").to_pylist()]
            numbers: dict = {}
            words: list[int] = []
            for i, text in enumerate(texts):
                words += [numbers.setdefault(w, len(numbers)) for w in text]
                words.append(numbers.setdefault(i, len(numbers)))     # an int equals no word
            lengths = np.array([len(t) + 1 for t in texts])
            found = runs_of(np.array(words, np.int64), lengths)
            found = found[found[:, 1] - found[:, 0] >= SHORTEST]
            found = found[np.lexsort((found[:, 2], found[:, 0]))]
            first = np.concatenate([[0], np.cumsum(lengths)])
            per = np.bincount(np.searchsorted(first, found[:, 0], "right") - 1, minlength=len(texts))
            cuts = np.concatenate([[0], np.cumsum(per)])
            collapsed = [b" ".join(t) for t in texts]
            for i in np.flatnonzero(per):
                own = found[cuts[i]:cuts[i + 1], :2] - first[i]
                change = np.zeros(lengths[i] + 1, np.int64)
                np.add.at(change, own[:, 0] + found[cuts[i]:cuts[i + 1], 2], 1)
                np.add.at(change, own[:, 1], -1)
                stays = np.cumsum(change)[:len(texts[i])] == 0
                collapsed[i] = b" ".join(w for w, s in zip(texts[i], stays.tolist()) if s)
            runs = pa.StructArray.from_arrays(
                [pa.array(found[:, 0] - np.repeat(first[:-1], per)), pa.array(found[:, 1] - found[:, 0]),
                 pa.array(found[:, 2])], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [field(batch, id_col), pa.array(lengths - 1), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), runs),
                 pa.array(collapsed, pa.binary()).cast(pa.string())],
                [id_col, "n_words", "runs", "collapsed"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, "text").mapInArrow(
        run, f"{id_col} {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
