"""Sparse product of a document-term matrix with itself: in how many documents two
words occur together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

CELLS = 1 << 22         # of a product that a task holds before it hands them on
STEP = 1 << 22          # entries of a product formed at a time
DENSE = 1 << 25         # cells of a product that a task holds as a plain matrix


def _entries(doc: np.ndarray, word: np.ndarray, n_words: int) -> Iterator[np.ndarray]:
    """Codes (first * n_words + second) of the pairs of words of each document, first
    before second, in pieces. Words are sorted and distinct within a document."""
    end = np.searchsorted(doc, doc, "right")
    at, apart, held, size = np.arange(len(doc)), 1, [], 0
    while True:
        at = at[at + apart < end[at]]
        if not len(at):
            break
        held.append(word[at] * n_words + word[at + apart])
        size += len(at)
        apart += 1
        if size >= STEP:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def _merged(codes: np.ndarray, counts: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    fresh, n = np.unique(more, return_counts=True)
    both, where = np.unique(np.concatenate([codes, fresh]), return_inverse=True)
    return both, np.bincount(where, np.concatenate([counts, n])).astype(np.int64)


def _row_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows of the tasks' matrices, sorted by word, to the cells of their sum."""
    total, now = None, None

    def cells() -> pa.RecordBatch:
        b = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), now)), pa.array(b), pa.array(total[b])], ["a", "b", "n_docs"])

    for batch in batches:
        for a, row in zip(batch.column("a").to_pylist(), batch.column("row")):
            row = np.frombuffer(row.as_buffer(), np.int64)
            if a == now:
                total = total + row
                continue
            if total is not None:
                yield cells()
            total, now = row, a
    if total is not None:
        yield cells()


def pair_counts(df: DataFrame, words: list[str], tokens: str = "tokens") -> DataFrame:
    """(src, dst, n_docs) for each two of ``words``, src < dst, that share a document.

    ``words`` go to every task. Up to ``DENSE`` cells, a task adds them up in a matrix over all
    its documents and hands on each row once, packed; there are at most as many
    tasks as cores, so rows out do not grow with the documents. Beyond, a task adds up the cells of the product over its
    documents and hands on each pair of words once, or once more whenever it holds
    ``CELLS`` of them, so rows out are bounded by distinct pairs, not by the
    squares of the documents' lengths. Nulls among tokens count for nothing.
    """
    words = sorted(set(words))
    shared = df.sparkSession.sparkContext.broadcast(words)      # the caller's k words

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        names, n_words = pa.array(shared.value, pa.string()), len(shared.value)
        for batch in batches:
            column = batch.column(0)
            found = pc.index_in(column.flatten(), names)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
            doc = np.repeat(np.arange(len(column)), sizes)
            known = np.asarray(pc.is_valid(found))
            cells = np.unique(doc[known] * n_words + np.asarray(found.drop_null()).astype(np.int64))
            yield from _entries(cells // n_words, cells % n_words, n_words)

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_words = len(shared.value)
        counts = np.zeros(n_words * n_words, np.int64)
        for more in cells_of(batches):
            np.add.at(counts, more, 1)
        counts = counts.reshape(n_words, n_words)
        for a in np.flatnonzero(counts.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([counts[a].tobytes()], pa.binary())], ["a", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_words = len(shared.value)
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(codes // n_words, pa.int64()), pa.array(codes % n_words, pa.int64()), pa.array(counts)], ["a", "b", "n"])

        for more in cells_of(batches):
            codes, counts = _merged(codes, counts, more)
            if len(codes) >= CELLS:
                yield rows()
                codes, counts = codes[:0], counts[:0]
        yield rows()

    if len(words) ** 2 <= DENSE:
        tasks = df.sparkSession.sparkContext.defaultParallelism
        sums = (df.select(tokens).coalesce(tasks).mapInArrow(matrix, "a long, row binary")
                .repartition("a").sortWithinPartitions("a").mapInArrow(_row_sums, "a long, b long, n_docs long"))
    else:
        sums = df.select(tokens).mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n_docs"))
    table = df.sparkSession.createDataFrame(list(enumerate(words)), "i long, word string")
    named = lambda column, out: F.broadcast(table.select(F.col("i").alias(column), F.col("word").alias(out)))  # noqa: E731  k rows
    return sums.join(named("a", "src"), "a").join(named("b", "dst"), "b").select("src", "dst", "n_docs")
