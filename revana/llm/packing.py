"""Packing token sequences by cutting-stock column generation.

Documents are cut into full sequences and one rest. The lengths of the rests, in
units of ``UNIT`` tokens, form a histogram, and a linear program over patterns
(multisets of lengths that fit one sequence) covers it with the fewest sequences.
Its columns are generated: a knapsack dynamic program over the dual prices finds
the best new pattern. Rounded down, the patterns take nearly all rests; a small
remainder is packed best-fit. Documents are ranked within their length and take
the places of the patterns in rank order.

Only the histogram (at most 2048 / UNIT numbers) and the patterns are on the
driver, whatever the corpus.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from revana.llm.common import field, running_sum, slices
from revana.workspace import materialise, tidy

CAPACITY = 2048
UNIT = 4
END_ID = 1
GAP = 1e-3                  # the program is solved to this relative gap,
ROUNDS = 60                 # or for so many pricing rounds
PIVOTS = 24                 # of at most so many new patterns each
PER_BUCKET = 20_000         # rows a ranking window holds on average
SPECIAL = "<|endoftext|>"


def _file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _ranks(path: str):
    """The same vocabulary in tiktoken, about four times as fast."""
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, tokenizer: str | None = None, ranks: str | None = None) -> np.ndarray:
    """Ids of a text, END_ID last. Null is empty.

    tiktoken gives the ids that the tokenizers file gives; a text with the string
    of a special token, and one that overflows the stack of tiktoken's matcher (millions of
    line breaks in a row do), goes to the tokenizers library itself.
    """
    ids = None if not text or SPECIAL in text else _fast(text, ranks or _file("byte_bpe_50k.tiktoken"))
    if text and ids is None:
        ids = _tokenizer(tokenizer or _file("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    return np.array([*(ids or []), END_ID], "<u4")


def _fast(text: str, ranks: str) -> list[int] | None:
    try:
        return _ranks(ranks).encode_ordinary(text)
    except BaseException as overflow:       # its class derives from no other and cannot be imported
        if type(overflow).__name__ != "PanicException":
            raise
        return None


def tokenise_and_cut(docs: DataFrame, id_col: str = "doc_id", with_ids: bool = False,
                     capacity: int = CAPACITY) -> DataFrame:
    """One row (id, start, length, ids_crc32, doc_tokens[, ids]) per piece.

    Cut after every ``capacity`` tokens. ``ids_crc32`` lets a reader verify what
    it decodes; the ids themselves come ``with_ids``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            which, start, length, crc, total, out = [], [], [], [], [], []
            for i, text in enumerate(field(batch, "text").to_pylist()):
                ids = encode(text)
                for s in range(0, len(ids), capacity):
                    piece = ids[s:s + capacity]
                    which.append(i)
                    start.append(s)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids))
                    if with_ids:
                        out.append(piece.astype(np.int32))
            arrays = [field(batch, id_col).take(pa.array(which, pa.int64())),
                      *(pa.array(c, pa.int64()) for c in (start, length, crc, total))]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                arrays.append(pa.array(out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select(id_col, "text").mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


# ---- the program -----------------------------------------------------------------

def price_patterns(prices: np.ndarray, units: np.ndarray, room: int, most: int) -> tuple[float, list[Counter]]:
    """Knapsack dynamic program over ``units`` (ascending) with their ``prices``.

    Returns the highest price that fits ``room``, and of the best patterns that
    hold each unit at least once those worth more than 1, best first.
    """
    value = np.zeros(room + 1)
    taken = np.full(room + 1, -1)
    fits = np.searchsorted(units, np.arange(room + 1), "right")
    for c in range(int(units[0]), room + 1):
        gains = value[c - units[:fits[c]]] + prices[:fits[c]]
        k = int(gains.argmax())
        if gains[k] > value[c - 1] + 1e-12:
            value[c], taken[c] = gains[k], k
        else:
            value[c] = value[c - 1]
    worth = prices + value[room - units]
    patterns = []
    for i in np.argsort(-worth, kind="stable")[:most]:
        if worth[i] <= 1 + 1e-7:
            break
        pattern, c = Counter({int(i): 1}), room - int(units[i])
        while c > 0:
            if taken[c] < 0:
                c -= 1
            else:
                pattern[int(taken[c])] += 1
                c -= int(units[taken[c]])
        patterns.append(pattern)
    return float(value[room]), patterns


def first_patterns(units: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[Counter, float, int]]:
    """A starting basis: patterns filled largest first, each used until one of its
    units is used up. That unit is in no later pattern, so the basis is triangular.
    Returns (pattern, times, the unit that is used up)."""
    left = demand.astype(float)
    basis: list[tuple[Counter, float, int]] = []
    for k in range(len(units) - 1, -1, -1):
        while left[k] > 0:
            pattern, free, i = Counter(), room, k
            while i >= 0:
                take = min(math.ceil(left[i]), free // int(units[i]))
                if take:
                    pattern[i] = take
                    free -= take * int(units[i])
                i = min(i, int(np.searchsorted(units, free, "right"))) - 1
            held = np.array(sorted(pattern))
            per = np.array([pattern[i] for i in held.tolist()])
            times = float((left[held] / per).min())
            used_up = held[left[held] - per * times <= 1e-9]
            left[held] -= per * times
            left[used_up] = 0
            basis.append((pattern, times, int(used_up[0])))
            basis += [(Counter({int(i): int(room // units[i])}), 0.0, int(i)) for i in used_up[1:]]
    return basis


def _triangular_inverse(basis: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inverse of a basis whose rows, taken in the order ``rows``, are lower
    triangular, by substitution.

    Neither here nor in ``solve`` is a BLAS or LAPACK routine called: their
    thread pool can stall for good in a driver that also runs the JVM gateway
    and tokenizers. The programs have a few hundred rows at most.
    """
    n = len(basis)
    lower = basis[rows]
    inverse = np.zeros((n, n))
    for k in range(n):
        inverse[k, k] = 1
        inverse[k] -= np.einsum("i,ij->j", lower[k, :k], inverse[:k])
        inverse[k] /= lower[k, k]
    out = np.empty((n, n))
    out[:, rows] = inverse
    return out


def solve(units: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> tuple[list[Counter], np.ndarray]:
    """Patterns and (fractional) numbers of sequences that cover the demand.

    Revised simplex on the patterns generated so far: one basis inverse, updated
    at each pivot, several pivots per dynamic program. A unit with a negative
    price may be covered more than asked (surplus column, of cost 0). Farley's
    bound tells how far the optimum can still be away; after ``ROUNDS`` programs
    the patterns at hand are used, which are feasible at any time.
    """
    n = len(units)
    patterns: list[Counter] = [Counter() for _ in range(n)]
    basis = np.zeros((n, n))
    x, cost, used_up = np.zeros(n), np.ones(n), np.zeros(n, int)
    for k, (pattern, times, unit) in enumerate(first_patterns(units, demand, room)):
        patterns[k], x[k], used_up[k] = pattern, times, unit
        basis[list(pattern), k] = list(pattern.values())
    inverse = _triangular_inverse(basis, used_up)

    def priced() -> np.ndarray:
        return np.einsum("i,ij->j", cost, inverse)

    def pivot(column: np.ndarray, pattern: Counter, price: float) -> None:
        d = np.einsum("ij,j->i", inverse, column)
        good = d > 1e-9
        if not good.any():
            return
        ratios = np.where(good, x / np.where(good, d, 1), np.inf)
        out = int(np.argmin(ratios))
        x[:] = np.maximum(x - ratios[out] * d, 0)
        x[out] = ratios[out]
        row = inverse[out] / d[out]
        inverse[:] -= np.outer(d, row)
        inverse[out] = row
        patterns[out], cost[out] = pattern, price

    for _ in range(ROUNDS if n else 0):
        prices = priced()
        for i in np.argsort(prices, kind="stable")[:PIVOTS]:
            if prices[i] < -1e-7 and np.einsum("i,i->", cost, inverse[:, i]) < -1e-7:
                pivot(-np.eye(1, n, i)[0], Counter(), 0.0)
        prices = np.maximum(priced(), 0)
        worth, found = price_patterns(prices, units, room, PIVOTS)
        if not found or 1 - 1 / worth <= gap:
            break
        for pattern in found:
            column = np.zeros(n)
            column[list(pattern)] = list(pattern.values())
            if np.einsum("i,i->", priced(), column) > 1 + 1e-7:
                pivot(column, pattern, 1.0)
    return patterns, x


def pack_histogram(histogram: dict[int, int], room: int) -> list[tuple[Counter, int]]:
    """(pattern {unit: copies}, number of sequences); places equal the histogram exactly."""
    units = np.array(sorted(histogram), int)
    demand = np.array([histogram[int(u)] for u in units], float)
    patterns, x = solve(units, demand, room)
    left = {int(u): int(d) for u, d in zip(units, demand)}
    plan: list[tuple[Counter, int]] = []
    for pattern, times in zip(patterns, np.floor(x + 1e-6).astype(int).tolist()):
        while times > 0:            # a pattern that covers too much drops what is used up
            own = Counter({int(units[i]): min(a, left[int(units[i])]) for i, a in pattern.items()})
            own = +own
            if not own:
                break
            now = min([times, *(left[u] // a for u, a in own.items())])
            plan.append((own, now))
            for u, a in own.items():
                left[u] -= a * now
            times -= now
    # What rounding left over: fewer items than patterns have places, best fit.
    rest = [u for u in sorted(left, reverse=True) for _ in range(left[u])]
    bins: dict[int, list[Counter]] = {}
    for u in rest:
        free = next((f for f in range(u, room + 1) if bins.get(f)), None)
        pattern = bins[free].pop() if free is not None else Counter()
        pattern[u] += 1
        bins.setdefault((room if free is None else free) - u, []).append(pattern)
    plan += Counter(frozenset(p.items()) for own in bins.values() for p in own).items()
    return [(Counter(dict(p)), n) for p, n in plan]


def _places(plan: list[tuple[Counter, int]]):
    """For each class, the ranks that a pattern takes there: arrays sorted by (class, rank)."""
    next_rank: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in plan:
        slot = 0
        for unit, copies in sorted(pattern.items(), reverse=True):
            rows.append((unit, next_rank[unit], copies, sequence, slot))
            next_rank[unit] += copies * times
            slot += copies
        sequence += times
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5)


def assign(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """``pieces`` (a written table) with sequence_id and offset.

    Every piece gets one place; offsets in a sequence are gapless from 0. An
    empty table stays empty. Pieces may repeat: each row is a piece of its own.
    """
    room = capacity // unit
    # Full pieces are a class of their own: nothing goes beside them.
    cls = F.when(F.col("length") == capacity, room + 1).otherwise(F.ceil(F.col("length") / unit)).cast("long")
    classed = pieces.withColumn("cls", cls)
    counts = {int(r.cls): r["n"] for r in classed.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}
    full = counts.pop(room + 1, 0)
    plan = pack_histogram(counts, room) if counts else []
    if full:
        plan.append((Counter({room + 1: 1}), full))
    places = _places(plan)                       # a few thousand rows at most
    starts = places[:, 0] << 44 | places[:, 1]
    buckets = max(1, -(-(sum(counts.values()) + full) // PER_BUCKET))
    bucketed = classed.withColumn("bucket", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(buckets)))
    ranked = running_sum(bucketed, ["cls"], "bucket", [id_col, "start", "ids_crc32"], F.lit(1), "rank")
    kept = [c for c in pieces.columns if c not in ("sequence_id", "slot")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = np.asarray(field(batch, "rank"))
            at = np.searchsorted(starts, np.asarray(field(batch, "cls")) << 44 | rank, "right") - 1
            own = places[at]
            k = rank - own[:, 1]
            copies = own[:, 2] if len(own) else np.ones(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(field(batch, c) for c in kept), pa.array(own[:, 3] + k // copies), pa.array(own[:, 4] + k % copies)],
                [*kept, "sequence_id", "slot"])

    fields = pieces.select(*kept).schema.add("sequence_id", "long").add("slot", "long")
    placed = ranked.select(*kept, "cls", "rank").mapInArrow(place, fields)
    before = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return (placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
            .drop("slot"))


@tidy
def pack(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pieces of ``docs`` (id, start, length, ids_crc32, doc_tokens) with their
    sequence_id and offset. Null and empty texts are one piece with END_ID."""
    return assign(materialise(tokenise_and_cut(docs, id_col), "pieces"), id_col)


def sequences(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, ids, lengths): the training sequences themselves, unpadded.

    The texts are cut again and each checksum is met, so that packing never
    moves the ids of the corpus more than this once. ``docs`` must have unique ids.
    """
    ids = tokenise_and_cut(docs, id_col, with_ids=True).select(id_col, "start", "ids_crc32", "ids")
    found = packed.join(ids, [id_col, "start", "ids_crc32"])
    return (found.groupBy("sequence_id")
            .agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
            .select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.length").alias("lengths")))
