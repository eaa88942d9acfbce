"""Hard negatives by zone maps over Hilbert-ordered blocks of vectors.

Candidates are ordered by label and by their place on a Hilbert curve and written
to Parquet as blocks of neighbours, each with its zone map: smallest and largest
value per dimension, smallest and largest label. Anchors are ordered alike and go
in groups. Interval arithmetic over a zone map bounds the inner products of an
anchor with all rows of a block from below and above.

An ask is an anchor with a window of scores, a side (rows of its own label or of
another) and a number of rows wanted, highest scores first. It is answered in two
rounds. The first reads, for each ask, the block whose bounds lie nearest the top
of the window. The worst of the rows wanted that it finds is a floor, and the second
round reads every other block whose bounds meet what the floor leaves of the
window. No bound is an estimate, so the answer is that of comparing all rows.

Positives are one ask per anchor; each positive's window is one ask for negatives.
Zone maps are read without the vectors, in chunks of bounded size that meet the
groups in tasks of bounded size. Only a count of blocks and three numbers on
the vectors reach the driver. How many blocks are left out depends on how far
apart the vectors lie: in many dimensions and without clusters the zone maps
leave out little, and each group then reads nearly all blocks, a block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from revana.llm.common import field
from revana.workspace import materialise, tidy

UNITS = 256             # a component is counted in units of 1 / UNITS
LARGEST = 1 << 24       # and clamped to so many of them, so that scores fit 64 bits
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95      # percent of the positive's score
BLOCK, GROUP = 512, 256             # rows of a block of candidates, of a group of anchors
BLOCK_BYTES = 1 << 18               # a block of long vectors has fewer rows
ZONES = 1024                        # zone maps that meet a group at a time
GROUPS_A_TASK = 64
CURVE_BITS = 4
EVER = 1 << 62          # beyond all scores


def quantised(vectors: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """(id, label, q): components as whole numbers. Rows with a null id, label,
    vector or component, or one that is not finite, are left out."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # Also large floats fit a double, and the clamp comes before the cast.
    units = lambda x: F.greatest(F.lit(-LARGEST * 1.0), F.least(
        F.lit(LARGEST * 1.0), x.cast("double") * UNITS))
    return (vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad)
            .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                    F.transform(vec_col, lambda x: F.floor(units(x)).cast("int")).alias("q")))


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve, as bytes in order, of rows of coordinates below
    2 ** bits. By undoing, bit by bit, the exchanges and inversions that
    turn the curve's corner cells; what is left is the Gray code of the place."""
    x = points.astype(np.uint32)
    n, d = x.shape
    for bit in range(bits - 1, 0, -1):
        below = np.uint32((1 << bit) - 1)
        for i in range(d):
            hit = (x[:, i] >> np.uint32(bit) & 1).astype(bool)
            swap = np.where(hit, np.uint32(0), (x[:, 0] ^ x[:, i]) & below)
            x[:, 0] ^= np.where(hit, below, swap)
            x[:, i] ^= swap
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turned = np.zeros(n, np.uint32)
    for bit in range(bits - 1, 0, -1):
        turned ^= np.where(x[:, -1] >> np.uint32(bit) & 1, np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= turned[:, None]
    planes = (x[:, None, :] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)[None, :, None] & 1).astype(np.uint8)
    return np.packbits(planes.reshape(n, -1), axis=1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column; short ones end in zeros."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten())
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(column), dims), flat.dtype)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def ordered(rows: DataFrame, dims: int, least: int, most: int) -> DataFrame:
    """``rows`` with their place on the curve, dealt out and sorted by (label, place, id)."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = (_matrix(field(batch, "q"), dims).astype(np.int64) - least << CURVE_BITS) // (most - least + 1)
            keys = hilbert_keys(np.clip(cells, 0, (1 << CURVE_BITS) - 1), CURVE_BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary())],
                                             [*batch.schema.names, "place"])

    placed = rows.mapInArrow(place, "id long, label long, q array<int>, place binary")
    # The id's hash cuts what lies in one place into as many ranges as it needs.
    keys = ["label", "place", F.xxhash64("id"), "id"]
    return placed.repartitionByRange(*keys).sortWithinPartitions(*keys, "q")


def cut(rows: DataFrame, dims: int, size: int) -> DataFrame:
    """Ordered rows as one row per ``size`` neighbours: (block, n, label_low,
    label_high, low, high, ids, labels, vectors), within a block by id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        number = TaskContext.get().partitionId() << 40

        def block(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            nonlocal number
            ids, labels, q = (np.concatenate(p) for p in zip(*parts))
            by = np.argsort(ids, kind="stable")
            ids, labels, q = ids[by].astype("<i8"), labels[by].astype("<i8"), q[by].astype("<i4")
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([v]) for v in (number, len(ids), int(labels.min()), int(labels.max()))]
                + [pa.array([v.tobytes()], pa.binary()) for v in (q.min(axis=0), q.max(axis=0), ids, labels, q)],
                ["block", "n", "label_low", "label_high", "low", "high", "ids", "labels", "vectors"])

        waiting = 0
        for batch in batches:
            ids, labels, q = np.asarray(field(batch, "id")), np.asarray(field(batch, "label")), _matrix(field(batch, "q"), dims)
            at = 0
            while at < len(ids):
                end = min(len(ids), at + size - waiting)
                held.append((ids[at:end], labels[at:end], q[at:end]))
                waiting += end - at
                at = end
                if waiting == size:
                    yield block(held)
                    held, waiting = [], 0
        if waiting:
            yield block(held)

    return rows.mapInArrow(run, "block long, n long, label_low long, label_high long, low binary, high binary, "
                                "ids binary, labels binary, vectors binary")


# ---- bounds and scores ------------------------------------------------------------

def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows, as whole numbers."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if largest < 2 ** 53:               # sums of doubles stay exact
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner products possible of each anchor with each zone."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return (_products(up, low) + _products(down, high), _products(up, high) + _products(down, low))


class Asks:
    """The asks of a group: rows (pos, k, low, high, floor) of one list value."""

    def __init__(self, asks: pa.Array, labels: np.ndarray, same: bool):
        get = lambda name: np.asarray(asks.field(name))
        self.pos, self.k, self.low, self.high, self.floor = (get(n) for n in ("pos", "k", "low", "high", "floor"))
        self.label, self.same = labels[self.pos], same

    def possible(self, label_low: np.ndarray, label_high: np.ndarray) -> np.ndarray:
        """(asks, blocks): whether a block can hold a row of the side asked for."""
        own = self.label[:, None]
        if self.same:
            return (label_low <= own) & (own <= label_high)
        return (label_low != own) | (label_high != own)

    def meets(self, least: np.ndarray, most: np.ndarray, floor: np.ndarray) -> np.ndarray:
        return (most >= floor[:, None]) & (least <= self.high[:, None])


def _group_rows(row: dict, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"),
            np.frombuffer(row["vectors"], "<i4").reshape(-1, dims))


def _lists(batch: pa.RecordBatch, name: str) -> Iterator[pa.Array]:
    column = field(batch, name)
    values, at = column.values, np.asarray(column.offsets)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield values.slice(a, b - a)


def chosen_blocks(groups: DataFrame, zones: DataFrame, dims: int, same: bool, seeds: bool) -> DataFrame:
    """(grp, block) to read: in the first round (``seeds``) the block of each chunk
    nearest the top of a window, in the second what else the floors leave."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["grp", "ids", "labels", "vectors"]).to_pylist()
            for row, own, zone in zip(rows, _lists(batch, "asks"), _lists(batch, "zones")):
                _, labels, vectors = _group_rows(row, dims)
                asks = Asks(own, labels, same)
                block, label_low, label_high = (np.asarray(zone.field(n)) for n in ("block", "label_low", "label_high"))
                low, high = (np.frombuffer(b"".join(zone.field(n).to_pylist()), "<i4").reshape(-1, dims)
                             for n in ("low", "high"))
                least, most = (b[asks.pos] for b in bounds(vectors, low, high))
                possible = asks.possible(label_low, label_high)
                fits = possible & asks.meets(least, most, asks.low)
                middle = np.abs((least + most) / 2 - asks.high[:, None])
                nearest = np.where(fits, middle, np.inf).argmin(axis=1)
                first = np.unique(nearest[fits.any(axis=1)])
                if not seeds:
                    wanted = (possible & asks.meets(least, most, asks.floor)).any(axis=0)
                    wanted[first] = False
                    first = np.flatnonzero(wanted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), row["grp"]), pa.int64()), pa.array(block[first], pa.int64())], ["grp", "block"])

    return groups.join(zones, ["chunk", "salt"]).select("grp", "ids", "labels", "vectors", "asks", "zones").mapInArrow(
        run, "grp long, block long")


def scored(reads: DataFrame, dims: int, same: bool, most: int) -> DataFrame:
    """(grp, pos, k, id, score): of each block read, the best ``most`` rows of each ask."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = batch.select([c for c in batch.schema.names if c != "asks"]).to_pylist()
            for row, own in zip(plain, _lists(batch, "asks")):
                ids, labels, vectors = _group_rows(row, dims)
                other_ids, other_labels, others = _group_rows({k: row[f"b_{k}"] for k in ("ids", "labels", "vectors")}, dims)
                asks = Asks(own, labels, same)
                score = _products(vectors, others)[asks.pos]
                side = asks.label[:, None] == other_labels
                fits = ((side == same) & (ids[asks.pos][:, None] != other_ids)
                        & (score >= asks.floor[:, None]) & (score <= asks.high[:, None]))
                left = np.where(fits, score, -2 * EVER)
                found = []
                for _ in range(min(most, len(other_ids))):
                    best = left.argmax(axis=1)              # of equal scores the smallest id
                    at = np.flatnonzero(left[np.arange(len(left)), best] > -2 * EVER)
                    if not len(at):
                        break
                    found.append((asks.pos[at], asks.k[at], other_ids[best[at]], left[at, best[at]]))
                    left[at, best[at]] = -2 * EVER
                if found:
                    pos, k, other, s = (np.concatenate(c) for c in zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(pos), row["grp"]), pa.int64()), pa.array(pos.astype(np.int32)), pa.array(k.astype(np.int32)),
                         pa.array(other, pa.int64()), pa.array(s, pa.int64())], ["grp", "pos", "k", "id", "score"])

    return reads.mapInArrow(run, "grp long, pos int, k int, id long, score long")


# ---- the search -------------------------------------------------------------------

class Search:
    """Written blocks of candidates and groups of anchors, and asks over them."""

    def __init__(self, candidates: DataFrame, anchors: DataFrame, dims: int, least: int, most: int):
        self.dims = dims
        rows = max(16, min(BLOCK, BLOCK_BYTES // (4 * dims)))
        self.blocks = materialise(cut(ordered(candidates, dims, least, most), dims, rows), "blocks")
        groups = cut(ordered(anchors, dims, least, most), dims, min(GROUP, rows))
        self.groups = materialise(groups.select(F.col("block").alias("grp"), "n", "ids", "labels", "vectors"), "groups")
        chunks = max(1, -(-self.blocks.select("block").count() // ZONES))
        self.salts = max(1, -(-self.groups.select("grp").count() // GROUPS_A_TASK))
        self.chunks = chunks
        zones = (self.blocks.groupBy(F.pmod(F.xxhash64("block"), F.lit(chunks)).alias("chunk"))
                 .agg(F.sort_array(F.collect_list(F.struct("block", "label_low", "label_high", "low", "high"))).alias("zones")))
        self.zones = materialise(zones, "zones")

    def positions(self) -> DataFrame:
        """(grp, pos) of each anchor."""
        return self.groups.select("grp", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("pos"))

    def _round(self, asks: DataFrame, same: bool, most: int, seeds: bool) -> DataFrame:
        packed = asks.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("pos", "k", "low", "high", "floor"))).alias("asks"))
        groups = materialise(self.groups.drop("n").join(packed, "grp"), "asks")
        numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        spread = groups.withColumn("salt", F.pmod(F.xxhash64("grp"), F.lit(self.salts))).withColumn("chunk", numbers(self.chunks))
        zones = self.zones.withColumn("salt", numbers(self.salts))
        reads = materialise(chosen_blocks(spread, zones, self.dims, same, seeds), "reads")
        payload = self.blocks.select("block", *(F.col(c).alias(f"b_{c}") for c in ("ids", "labels", "vectors")))
        # Merged by shuffle: neither side has a size that allows sending it everywhere.
        met = reads.join(payload.hint("merge"), "block").join(groups.hint("merge"), "grp")
        return scored(met, self.dims, same, most)

    def answer(self, asks: DataFrame, same: bool, most: int) -> DataFrame:
        """(grp, pos, k, id, score, rank): the best ``most`` rows of each of ``asks``
        (grp, pos, k, low, high), equal scores by id."""
        key = ["grp", "pos", "k"]
        rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("score"), "id"))
        best = lambda rows: rows.withColumn("rank", rank).filter(F.col("rank") <= most)
        first = materialise(best(self._round(asks.withColumn("floor", F.col("low")), same, most, True)).drop("rank"), "first")
        floors = first.groupBy(*key).agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("found"))
        floor = F.when(F.col("found") == most, F.col("worst")).otherwise(F.col("low"))
        raised = asks.join(floors, key, "left").withColumn("floor", floor).drop("worst", "found")
        return best(first.unionByName(self._round(materialise(raised, "raised"), same, most, False)))


@tidy
def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label",
         vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score,
    negative_score) for the rows of ``vectors`` that meet ``is_anchor``, a condition
    on ``id``.

    Scores are inner products of components in whole units of 1/256, rounded down. An anchor's positives are
    its ``POSITIVES`` rows of highest score with its label; the negatives of a
    positive are the ``NEGATIVES`` rows of highest score with another label and between
    ``LOW`` and ``HIGH`` percent of the positive's score. Equal scores go by id.

    Rows with a null id, label, vector or component, or one that is not finite,
    take no part; an empty table gives an empty one. Components beyond 65,536 either
    way count as that. Short vectors are filled up with zeros. Rows that share an
    id are not partners of each other; each is a candidate, and each anchor among
    them has its own results. Other columns are ignored. An id with its label and score tells
    rows apart; rows equal in all three are interchangeable.
    """
    spark = vectors.sparkSession
    rows = materialise(quantised(vectors, id_col, label_col, vec_col), "quantised")
    shape = rows.agg(F.max(F.size("q")).alias("dims"), F.min(F.array_min("q")).alias("least"), F.max(F.array_max("q")).alias("most")).first()
    if shape.dims is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    search = Search(rows, rows.filter(is_anchor), max(1, shape.dims), shape.least or 0, shape.most or 0)
    every = search.positions().select("grp", "pos", F.lit(0).alias("k"), F.lit(-EVER).alias("low"), F.lit(EVER).alias("high"))
    positives = search.answer(every, True, POSITIVES)
    s = F.col("score")
    share = lambda percent: F.expr(f"score div 100 * {percent} + score % 100 * {percent} div 100")
    # Rounded towards zero, which is up for the lower end only below zero.
    low = share(LOW) + F.when((s > 0) & (s % 100 * LOW % 100 != 0), 1).otherwise(0)
    high = share(HIGH) - F.when((s < 0) & (s % 100 * HIGH % 100 != 0), 1).otherwise(0)
    asks = materialise(positives.select("grp", "pos", F.col("rank").alias("k"), F.col("id").alias("positive_id"),
                                        s.alias("positive_score"), low.alias("low"), high.alias("high")), "positives")
    negatives = search.answer(asks.filter("low <= high").select("grp", "pos", "k", "low", "high"), False, NEGATIVES)
    ids = search.groups.select("grp", "ids").mapInArrow(_anchor_ids, "grp long, pos int, anchor_id long")
    return (negatives.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
            .join(asks.drop("low", "high"), ["grp", "pos", "k"]).join(ids, ["grp", "pos"])
            .select("anchor_id", "positive_id", F.col("k").alias("positive_rank"), "rank", "negative_id",
                    "positive_score", "negative_score"))


def _anchor_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.frombuffer(raw, "<i8") for raw in field(batch, "ids").to_pylist()]
        n = [len(i) for i in ids]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.asarray(field(batch, "grp")), n)),
             pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in n] or [np.zeros(0, np.int32)])),
             pa.array(np.concatenate(ids or [np.zeros(0, np.int64)]))], ["grp", "pos", "anchor_id"])
