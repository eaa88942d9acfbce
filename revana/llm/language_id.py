"""Language identification with rank-order n-gram profiles.

Each language is described by its most frequent letter n-grams (1 to 3 letters,
blanks mark word borders), in order of frequency. A document's own most frequent
n-grams are compared with every profile by the out-of-place distance: the sum of
the rank differences, ``size`` for an n-gram the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from revana.llm.common import field, slices

PROFILE_SIZE = 400
MAX_LANGUAGES = 10_000      # more names than languages exist are a wrong column, and an error
UNDETERMINED = "und"
PIECE = 1 << 20             # letters counted in one numpy step


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, as packed code points in ascending order, and
    their counts. Case is folded to lower; what is no letter is a blank."""
    padded = f" {text.lower()} "
    parts = []
    for start in range(0, max(1, len(padded) - 1), PIECE):
        points = np.frombuffer(padded[start:start + PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        last = start + PIECE + 2 >= len(padded)
        points = np.where(_letters()[points], points, 32).astype(np.int64)
        letter = points != 32
        n = len(points) if last else PIECE
        one = points[:n][letter[:n]]
        pair = (points[:-1] << 21 | points[1:])[:n][(letter[:-1] | letter[1:])[:n]]
        triple = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[:n][letter[1:-1][:n]]
        keys = np.sort(np.concatenate([one, pair, triple]))
        if len(keys):
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            parts.append((keys[first], np.diff(np.concatenate([first, [len(keys)]]))))
    if len(parts) == 1:
        return parts[0]
    return merge_counts(parts)


def merge_counts(parts) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, where, np.concatenate([n for _, n in parts]))
    return keys, counts


def ranked(text: str, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code points."""
    keys, counts = ngram_counts(text)
    return keys[np.argsort(-counts, kind="stable")[:size]]


@dataclass
class Profiles:
    """``ranks[i, j]``: rank of n-gram ``keys[i]`` in language ``langs[j]``, -1 if absent."""

    langs: list[str]
    keys: np.ndarray
    ranks: np.ndarray
    size: int

    def distances(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(self.langs), self.size * max(1, len(grams)))
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        ranks = np.where((self.keys[at] == grams)[:, None], self.ranks[at], -1)
        apart = np.abs(ranks - np.arange(len(grams))[:, None])
        return np.where(ranks < 0, self.size, apart).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ranked(text, self.size) if text else np.zeros(0, np.int64)
        if not len(grams) or not self.langs:
            return UNDETERMINED, 0.0
        d = self.distances(grams)
        best = int(np.argmin(d))            # ties: first in alphabetical order
        return self.langs[best], float(1 - d[best] / (self.size * len(grams)))


def learn_profiles(df: DataFrame, size: int = PROFILE_SIZE) -> Profiles:
    """Profiles from every row of ``df`` (text, lang) with a language and a text.

    N-grams are counted inside the tasks and summed after one shuffle of
    (language, n-gram, count); only ``size`` rows per language reach the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts: dict[str, list[str]] = {}
            for lang, text in zip(field(batch, "lang").to_pylist(), field(batch, "text").to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                keys, n = ngram_counts(" ".join(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)],
                    ["lang", "gram", "n"])

    rows = df.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = (rows.mapInArrow(count, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = (counts.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < size)
           .select("lang", "gram", "rank").limit(size * MAX_LANGUAGES + 1).collect())
    if len(top) > size * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted({r.lang for r in top})
    keys = np.array(sorted({r.gram for r in top}), np.int64)
    column = {name: j for j, name in enumerate(langs)}
    row = {key: i for i, key in enumerate(keys.tolist())}
    ranks = np.full((len(keys), len(langs)), -1, np.int64)
    for r in top:
        ranks[row[r.gram], column[r.lang]] = r.rank
    return Profiles(langs, keys, ranks, size)


def predict_language(df: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score (1: same order as the profile, 0: nothing shared).

    A null text, or one without a letter, is ``und`` with score 0, and so is
    every text if nothing was learned. Rows are neither dropped nor merged; own
    columns named lang_pred or score are replaced.
    """
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    shared = df.sparkSession.sparkContext.broadcast(profiles)   # size * languages entries

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, text):
            found = [model.predict(t) for t in field(batch, text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [field(batch, c) for c in kept]
                + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*kept, "lang_pred", "score"])

    fields = df.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    return df.select(*kept).mapInArrow(score, fields)


def identify(docs: DataFrame, train: Column, size: int = PROFILE_SIZE) -> DataFrame:
    """Learn from the rows of ``docs`` for which ``train`` is true, predict all rows."""
    return predict_language(docs, learn_profiles(docs.filter(train), size))
