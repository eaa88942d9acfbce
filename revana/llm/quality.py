"""Quality scores from a factorisation machine.

A document is a sparse vector: hashed words (L2-normalised log counts), binned
structure statistics and the binned n_chars of its metadata. The machine adds a
low-rank interaction for every pair of features; with the identity
sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2
a score costs a time linear in the number of features present.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from revana.llm.common import Rolling, bytes_table, field, lower_ascii, slices, utf8, word_spans
from revana.workspace import materialise

WORD_BINS = 1 << 15
STATS, STAT_BINS = 14, 16
FEATURES = WORD_BINS + STATS * STAT_BINS
RANK = 8
TRAINING_ROWS = 20_000      # the bound of the labelled sample that is fitted
SEED = 7

_ALNUM = bytes_table((48, 57), (65, 90), (97, 122), (128, 255))
_NOT_WORD = ~_ALNUM


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(mask)])
    return run[offsets[1:]] - run[offsets[:-1]]


def features(texts: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR (offsets, feature ids, values) of the texts; null counts as empty."""
    data, offsets = utf8(texts)
    n = len(texts)
    low = lower_ascii()[data]
    starts, ends, doc = word_spans(low, offsets, _NOT_WORD)
    hashes = Rolling(low).spans(starts, ends)
    pair = doc * WORD_BINS + (hashes >> np.uint64(49)).astype(np.int64)
    ids, counts = np.unique(pair, return_counts=True)
    rows, words = ids // WORD_BINS, ids % WORD_BINS
    values = np.log1p(counts)
    norm = np.sqrt(np.bincount(rows, values ** 2, n))
    values = values / np.maximum(norm[rows], 1e-12)

    size = np.diff(offsets).astype(float)
    per = np.maximum(size, 1)
    n_words = np.bincount(doc, minlength=n).astype(float)
    distinct = np.bincount(rows, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, rows, counts)
    lengths = np.bincount(doc, ends - starts, n)
    same = np.zeros(n)
    if len(starts) > 1:
        repeat = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        same = np.bincount(doc[1:], repeat, n)
    odd = ~_ALNUM[data] & (data > 32)
    run = np.zeros(len(data), bool)
    run[1:] = (data[1:] == data[:-1]) & odd[1:]
    share = lambda mask: _per_text(mask, offsets) / per
    word = np.maximum(n_words, 1)
    chars = np.array([np.nan if c is None else float(c) for c in n_chars.to_pylist()], float)
    stats = [
        np.log2(1 + size) / 24, np.log2(1 + n_words) / 20, np.log2(1 + np.nan_to_num(chars)) / 24,
        distinct / word, most / word, lengths / word / 16, same / word,
        4 * share(odd), 8 * share(run), 4 * share((data >= 48) & (data <= 57)),
        4 * share((data >= 65) & (data <= 90)), 16 * share(data == 10), 2 * share(data >= 128),
        8 * share(data == 124),
    ]
    bins = [np.clip((s * (STAT_BINS - 1)).astype(int), 0, STAT_BINS - 2) + (s > 0) for s in stats]
    bins = np.clip(np.stack(bins, 1), 0, STAT_BINS - 1)
    bins[np.isnan(chars), 2] = 0
    stat_ids = WORD_BINS + np.arange(STATS) * STAT_BINS + bins

    rows = np.concatenate([rows, np.repeat(np.arange(n), STATS)])
    ids = np.concatenate([words, stat_ids.ravel()])
    values = np.concatenate([values, np.full(n * STATS, STATS ** -0.5)])
    order = np.argsort(rows, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    return starts, ids[order], values[order]


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray          # one per feature
    factors: np.ndarray          # RANK per feature

    def margins(self, starts, ids, values):
        """Scores before the logistic function, and the sums of v_i x_i."""
        def add(x):
            return np.add.reduceat(x, starts[:-1], axis=0) if len(starts) > 1 else x[:0]
        vx = self.factors[ids] * values[:, None]
        sums = add(vx)
        pairs = 0.5 * (sums ** 2 - add(vx ** 2)).sum(axis=1)
        return self.bias + add(self.weights[ids] * values) + pairs, sums

    def predict(self, starts, ids, values) -> np.ndarray:
        z, _ = self.margins(starts, ids, values)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(starts, ids, values, labels, epochs: int = 6, batch: int = 512, rate: float = 0.02,
        decay: float = 1e-5) -> FactorisationMachine:
    """Logistic loss, Adam, rows in a seeded order. Without rows every score is 0.5."""
    rng = np.random.default_rng(SEED)
    n = len(labels)
    table = np.zeros((FEATURES, 1 + RANK))
    table[:, 1:] = rng.normal(0, 0.05, (FEATURES, RANK))
    model = FactorisationMachine(0.0, table[:, 0], table[:, 1:])
    first, second = np.zeros_like(table), np.zeros_like(table)
    step = 0
    if n:
        p = np.clip(labels.mean(), 0.01, 0.99)
        model.bias = float(np.log(p / (1 - p)))
    for _ in range(epochs if n else 0):
        shuffled = rng.permutation(n)
        for k in range(0, n, batch):
            rows = shuffled[k:k + batch]
            sizes = starts[rows + 1] - starts[rows]
            at = np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            i, x = ids[at], values[at]
            own = np.concatenate([[0], np.cumsum(sizes)])
            z, sums = model.margins(own, i, x)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / len(rows)
            e = np.repeat(error, sizes)
            grad = np.empty((len(i), 1 + RANK))
            grad[:, 0] = e * x
            grad[:, 1:] = (e * x)[:, None] * (np.repeat(sums, sizes, axis=0) - model.factors[i] * x[:, None])
            seen, where = np.unique(i, return_inverse=True)
            g = np.stack([np.bincount(where, grad[:, c], len(seen)) for c in range(1 + RANK)], 1)
            g += decay * table[seen]
            step += 1
            first[seen] = 0.9 * first[seen] + 0.1 * g
            second[seen] = 0.999 * second[seen] + 0.001 * g * g
            table[seen] -= rate * (first[seen] / (1 - 0.9 ** step)) / (np.sqrt(second[seen] / (1 - 0.999 ** step)) + 1e-8)
            model.bias -= rate * error.sum()
    return model


def _first_hashes(rows: DataFrame, bound: int) -> DataFrame:
    """The rows of ``rows`` (with ``_h``, below 2 ** 30) whose hash is below the largest
    limit that at most ``bound`` rows meet, narrowed to it by two histograms of 2 ** 15 bins."""
    low, width, left = 0, 1 << 30, bound
    for _ in range(2):
        step = width >> 15
        bins = dict(rows.filter((F.col("_h") >= low) & (F.col("_h") < low + width))
                    .groupBy(F.floor((F.col("_h") - low) / step).alias("b")).agg(F.count(F.lit(1)).alias("n"))
                    .select("b", "n").toArrow().to_pandas().itertuples(index=False, name=None))
        for b in sorted(bins):
            if bins[b] > left:
                low, width = low + b * step, step
                break
            left -= bins[b]
        else:
            return rows.filter(F.col("_h") < low + width)
    return rows.filter(F.col("_h") < low)


def train(docs: DataFrame, labels: DataFrame, rows: Column, bound: int = TRAINING_ROWS,
          id_col: str = "doc_id", label: str = "quality") -> FactorisationMachine:
    """Fit on the labelled rows of ``docs`` for which ``rows`` is true.

    At most ``bound`` of them are used, those with the smallest hashes of id, text and
    label, up to a limit read from a histogram of the hashes: the sample, and with it
    the fit on the driver, is bounded for any table, also if one id holds a third of
    it. Rows equal in id, text and label count once, and with several
    labels for one id each counts once. Rows with a null id or label are not used.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & rows)
    known = known.select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("_y")).distinct()
    named = docs.select(F.col(id_col).alias("_id"), F.xxhash64("text", F.lit(1)).alias("_t1"), F.xxhash64("text", F.lit(2)).alias("_t2"))
    order = F.pmod(F.xxhash64("_id", "_t1", "_y", F.lit(SEED)), F.lit(1 << 30))
    chosen = named.join(known, "_id").distinct().withColumn("_h", order)
    chosen = materialise(_first_hashes(materialise(chosen, "labelled"), bound), "sample")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            starts, ids, values = features(field(batch, "text"), field(batch, "n_chars"))
            offsets = pa.array(starts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [field(batch, "_id"), field(batch, "_t1"), field(batch, "_y"),
                 pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(values, pa.float32()))],
                ["_id", "_t1", "_y", "ids", "values"])

    found = (docs.select(F.col(id_col).alias("_id"), "text", F.col("n_chars").cast("long").alias("n_chars"))
             .withColumn("_t1", F.xxhash64("text", F.lit(1))).withColumn("_t2", F.xxhash64("text", F.lit(2)))
             .join(chosen, ["_id", "_t1", "_t2"])
             .groupBy("_id", "_t1", "_t2", "_y").agg(F.min("text").alias("text"), F.min("n_chars").alias("n_chars"))
             .mapInArrow(extract, "_id long, _t1 long, _y double, ids array<int>, values array<float>"))
    got = found.toArrow().combine_chunks().sort_by([("_id", "ascending"), ("_t1", "ascending"), ("_y", "ascending")])
    if not got.num_rows:
        return fit(np.zeros(1, int), np.zeros(0, int), np.zeros(0), np.zeros(0))
    ids = got["ids"].combine_chunks()
    starts = np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths()))])
    return fit(starts, np.asarray(ids.flatten()).astype(np.int64),
               np.asarray(got["values"].combine_chunks().flatten()).astype(float), np.asarray(got["_y"]))


def score(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, score, predicted) of every row. Null and empty texts are scored
    from their statistics alone; repeated rows are scored each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)    # FEATURES * (RANK + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = shared.value.predict(*features(field(batch, "text"), field(batch, "n_chars")))
            yield pa.RecordBatch.from_arrays(
                [field(batch, id_col), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                [id_col, "score", "predicted"])

    rows = docs.select(id_col, "text", F.col("n_chars").cast("long").alias("n_chars"))
    return rows.mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, score double, predicted int")
