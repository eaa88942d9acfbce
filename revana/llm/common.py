"""Helpers that several operators share: text buffers, byte hashes, running sums, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from revana.workspace import materialise, tidy

SLICE = 2 << 20                       # bytes of text that one numpy step handles
MULTIPLIER = 0x9E3779B97F4A7C15 | 1   # odd, so it has an inverse modulo 2**64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_row(column: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, is ``remainder``. Null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder


# ---- text as numpy ----------------------------------------------------------

def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and len + 1 offsets. Null is empty."""
    n, at = len(column), column.offset
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    if n == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[at:at + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    data = data[offsets[0]:offsets[-1]]
    offsets -= offsets[0]
    if column.null_count:
        empty = np.asarray(column.is_null())
        lengths = np.where(empty, 0, np.diff(offsets))
        if lengths.sum() != len(data):      # bytes under a null: copy what counts
            keep = np.repeat(~empty, np.diff(offsets))
            data = data[keep]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
    return data, offsets


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def field(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


# ---- hashes -----------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, SLICE + 1)
        for k, base in enumerate((MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


class Rolling:
    """64-bit polynomial hashes of any byte span of ``data``, from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values()[data] * up[:len(data)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        """Hash of the ``k`` bytes from each position; len(data) - k + 1 of them."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
    """Starts and ends of the maximal runs of other bytes, never across texts,
    and the index of the text each belongs to."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separator[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | fresh))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | fresh))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def bytes_table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low:high + 1] = True
    return out


WHITE = bytes_table((0x20, 0x20), (0x09, 0x0D))


@lru_cache(maxsize=1)
def lower_ascii() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


# ---- distributed running sums -------------------------------------------------

def running_sum(df: DataFrame, by: list[str], bucket: str, order: list[str | Column],
                value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row in (``bucket``, ``order``),
    separately per ``by``; keys must not be null.

    Buckets are summed first, so a group as large as the table still runs in as
    many windows as it has buckets.
    """
    valued = df.withColumn("_v", value)
    before = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = (valued.groupBy(*by, bucket).agg(F.sum("_v").alias("_s"))
               .select(*by, bucket, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o")))
    inside = W.partitionBy(*by, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (valued.withColumn("_r", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
            .join(offsets, [*by, bucket])
            .withColumn(out, F.col("_o") + F.col("_r")).drop("_v", "_r", "_o"))


# ---- connected components -------------------------------------------------------

@tidy
def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node of ``edges`` (a, b) reaches.

    Every round each node takes the smallest root among its neighbours, roots
    hook onto smaller ones, and paths are halved; the number of rounds grows
    with the logarithm of the longest path. Tables are written between rounds,
    nothing but a count reaches the driver.
    """
    both = materialise(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    both = both.select("a", "b").union(both.select(F.col("b"), F.col("a")))
    state = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("root"))
                        .select(F.col("a").alias("node"), "root"), "roots")
    while True:
        across = (both.join(state, both.a == state.node).select("b", "root")
                  .join(state.select(F.col("node").alias("b"), F.col("root").alias("own")), "b")
                  .filter("root <> own"))
        hooks = (across.select(F.greatest("root", "own").alias("node"),
                               F.least("root", "own").alias("to"))
                 .groupBy("node").agg(F.min("to").alias("to")))
        hooks = materialise(hooks, "hooks")
        if hooks.isEmpty():
            return state
        while True:            # roots that hook onto hooked roots
            far = hooks.join(hooks.select(F.col("node").alias("to"), F.col("to").alias("further")),
                             "to", "left")
            moved = materialise(far.select("node", F.coalesce("further", "to").alias("to"),
                                           F.col("further").isNotNull().alias("moved")), "hooks")
            hooks = moved.select("node", "to")
            if moved.filter("moved").isEmpty():
                break
        state = materialise(
            state.join(hooks.select(F.col("node").alias("root"), "to"), "root", "left")
            .select("node", F.coalesce("to", "root").alias("root")), "roots")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal ``keys`` in sorted rows. For groups of bounded size only."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(field(batch, k).to_pylist() for k in keys)))
        start = 0
        for i, value in enumerate(values):
            if value != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, value
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
