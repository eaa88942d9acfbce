"""Periodic runs against every period of every stretch."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from revana.llm import periodic_runs, queries
from tests.llm.test_llm import ODD, SF, documents, read


def brute_runs(words):
    """(start, end, period) of all runs of exponent 4 or more."""
    n, found = len(words), []
    ids = np.unique(np.array(words, object), return_inverse=True)[1] if n else np.zeros(0, int)
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[0], ids[:-q] == ids[q:], [0]]).astype(np.int8)
        edges = np.flatnonzero(np.diff(same))
        for s, e in zip(edges[::2].tolist(), (edges[1::2] + q).tolist()):
            if e - s >= 4 * q and not any((ids[s:e - r] == ids[s + r:e]).all() for r in range(1, q)):
                found.append((s, e, q))
    return sorted(found)


def brute_row(words):
    runs = [(s, e, q) for s, e, q in brute_runs(words) if e - s >= 6]
    runs.sort(key=lambda r: (r[0], r[2]))
    dropped = {i for s, e, q in runs for i in range(s + q, e)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return [(s, e - s, q) for s, e, q in runs], kept


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_all_periods(seed):
    rng = random.Random(seed)
    for _ in range(150):
        ids, lengths, expected, off = [], [], [], 0
        for k in range(rng.randint(1, 4)):
            letters, n = rng.choice([1, 2, 2, 3, 5, 50]), rng.choice([0, 1, 5, 9, 20, 40, 80, 150, 300])
            words = [rng.randrange(letters) for _ in range(n)]
            for _ in range(rng.randint(0, 3) if n > 6 else 0):
                s = rng.randrange(n)
                p = rng.randint(1, max(1, (n - s) // rng.choice([2, 3, 4, 5, 6, 8])))
                for i in range(s, min(n, s + rng.randint(1, 9) * p + rng.randint(0, p))):
                    words[i] = words[s + (i - s) % p]
            expected += [(s + off, e + off, q) for s, e, q in brute_runs(words)]
            ids += words + [1000 + k]
            lengths.append(n + 1)
            off += n + 1
        got = periodic_runs.runs_of(np.array(ids, np.int64), np.array(lengths))
        assert sorted(map(tuple, got.tolist())) == sorted(expected)


def test_fibonacci_and_nested_powers():
    a, b = "0", "01"
    for _ in range(11):
        a, b = b, b + a
    nested = ("ab" * 5 + "c") * 5 + "d"
    for text in (b, b * 5, nested * 6, "a" * 500, "aab" * 100 + "aab"[:2]):
        words = list(text)
        ids = np.append(np.unique(words, return_inverse=True)[1], 9)
        got = periodic_runs.runs_of(ids, np.array([len(ids)]))
        assert sorted(map(tuple, got.tolist())) == brute_runs(words)


def test_selected_positions_depend_on_their_context_and_are_dense():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2, 4000)
    words[1000:2000] = words[2500:3500]
    t, names = 8, np.unique(np.lib.stride_tricks.sliding_window_view(words, 8), axis=0, return_inverse=True)[1].ravel()
    periodic = np.array([any((words[i:i + t - r] == words[i + r:i + t]).all() for r in (1, 2)) for i in range(len(names))])
    selected = periodic_runs.synchronising_set(names, t, periodic)
    chosen = np.zeros(len(words), bool)
    chosen[selected] = True
    contexts = {}
    for i in range(len(words) - 2 * t):
        assert contexts.setdefault(words[i:i + 2 * t].tobytes(), chosen[i]) == chosen[i]
        window = words[i:i + 3 * t - 1]
        if i + 3 * t < len(words) and not any((window[:-r] == window[r:]).all() for r in (1, 2)):
            assert chosen[i:i + t].any()
    assert chosen.mean() < 0.5


def test_odd_rows(spark):
    texts = [*ODD, "go go go go go go stop", "a b c\x0bd " * 9, "x " * 6, "x " * 5, "a b " * 4, ODD[4], "z " * 40_000]
    docs = documents(spark, texts, [None, 7, 7, *range(len(texts) - 3)]).selectExpr(
        "*", "1 AS n_words", "2 AS runs", "3 AS collapsed", "4 AS start")
    rows = periodic_runs.collapse_runs(docs).collect()
    assert len(rows) == len(texts)
    found = {(r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in rows}
    for text in texts:
        if text != texts[-1]:
            runs, kept = brute_row(words_of(text))
            assert (len(words_of(text)), tuple(runs), kept) in found
    assert (40_000, ((0, 40_000, 1),), "z") in found
    assert periodic_runs.collapse_runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force_on_whole_documents(spark):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    docs = read("documents")
    assert len(got) == len(docs)
    edited = 0
    for doc_id, text, *_ in docs:
        words = words_of(text)
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            edited += 1
        runs, kept = brute_row(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert tuple(got[doc_id]) == (
            doc_id, len(runs), best[0], best[1], best[2], best[1] and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
    assert edited > 5


def test_rows_without_id_are_not_edited(spark):
    docs = documents(spark, ["a b c d", "a b c d"], [None, 1])
    assert queries.periodically_edited(docs.filter("doc_id IS NULL")).first().text == "a b c d"
