"""Exact ranks and selections in hash order, without one global sort.

``md5(seed:id)`` spreads rows evenly over its first digits. Counting rows per
prefix gives every prefix the rank at which it starts; inside a prefix a window
over a small, even share of the rows gives the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def seeded_hash(seed, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def prefix_digits(rows: int, per_window: int = 20_000) -> int:
    """Hex digits that leave about ``per_window`` of so many rows to a prefix."""
    return max(1, math.ceil(math.log(max(1, rows) / per_window, 16))) if rows > per_window else 1


def hash_rank(df: DataFrame, hashed: Column, id_col: str, by: tuple[str, ...] = (),
              digits: int = 3, out: str = "rank") -> DataFrame:
    """1-based rank of each row by (hash, id), separately per value of ``by``.

    16 ** ``digits`` prefixes per group; the offsets are that small a table.
    """
    by = list(by)
    keyed = df.withColumn("_h", hashed).withColumn("_p", F.substring("_h", 1, digits))
    counts = keyed.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*by, "_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"))
    local = F.row_number().over(W.partitionBy(*by, "_p").orderBy("_h", id_col))
    return (keyed.withColumn("_r", local)
            .join(offsets, [*by, "_p"])
            .withColumn(out, F.col("_o") + F.col("_r"))
            .drop("_h", "_p", "_r", "_o"))


def hash_cutoff(df: DataFrame, hashed: Column, id_col: str, share: float,
                digits: int = 4) -> DataFrame:
    """One row (h, id): the last of the first ceil(``share`` * n) rows by (hash, id).

    Only the prefix in which the cut falls is ordered, 1/16 ** ``digits`` of the
    rows, so the caller can take the split with a plain filter.
    """
    keyed = df.select(hashed.alias("h"), F.col(id_col).alias("id"))
    keyed = keyed.withColumn("p", F.substring("h", 1, digits))
    counts = keyed.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    run = W.orderBy("p").rowsBetween(W.unboundedPreceding, 0)
    everything = W.orderBy("p").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cut = (counts
           .withColumn("upto", F.sum("n").over(run))
           .withColumn("goal", F.ceil(F.sum("n").over(everything) * F.lit(share)))
           .filter((F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("n") < F.col("goal")))
           .select("p", (F.col("goal") - F.col("upto") + F.col("n")).alias("need")))
    return (keyed.join(F.broadcast(cut), "p")      # one row
            .withColumn("r", F.row_number().over(W.partitionBy("p").orderBy("h", "id")))
            .filter(F.col("r") == F.col("need")).select("h", "id"))
