"""Joining word-keyed facts to a word table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revana.workspace import materialise

BROADCAST_ROWS = 1_000_000
BROADCAST_CHARS = 32_000_000


def word_lookup(facts: DataFrame, table: DataFrame, key: str = "word",
                weight: str = "n", limit: int = BROADCAST_ROWS) -> list[DataFrame]:
    """Inner join of ``facts`` with ``table`` (unique ``key``), as disjoint parts
    for the caller to aggregate and union.

    A table of at most ``limit`` rows and ``BROADCAST_CHARS`` characters is
    broadcast, and the facts are not shuffled. Of a larger one only the words
    of the largest ``weight``, cut at a power of two, are broadcast. They are the hot keys, so what
    remains for the shuffle join is both smaller and even. No row is left out.

    ``table`` should be a written table: it is measured here.
    """
    rows, chars = table.agg(F.count(F.lit(1)), F.sum(F.length(key))).first()
    if rows <= limit and (chars or 0) <= BROADCAST_CHARS:
        return [facts.join(F.broadcast(table), key)]
    longest = BROADCAST_CHARS // limit
    head = materialise(table.filter((F.length(key) <= longest) & (F.col(weight) >= _least(table, weight, limit))),
                       "lookup-head")
    tail = table.join(F.broadcast(head.select(key)), key, "left_anti")
    rest = facts.join(F.broadcast(head.select(key)), key, "left_anti")
    return [facts.join(F.broadcast(head), key), rest.join(tail, key)]


def _least(table: DataFrame, weight: str, limit: int) -> int:
    """The smallest power of two that at most ``limit`` weights reach: read from a
    histogram of a few dozen bins, so that nothing is sorted or merged in one task."""
    bins = (table.filter(F.col(weight) > 0).groupBy(F.floor(F.log2(weight)).alias("e"))
            .agg(F.count(F.lit(1)).alias("n")).collect())
    reached, least = 0, None
    for row in sorted(bins, key=lambda r: -r.e):
        reached += row["n"]
        if reached > limit:
            break
        least = 2 ** row.e
    return least if least is not None else 1 << 62     # even the heaviest bin is too large: no head


def union_all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
