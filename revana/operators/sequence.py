"""Numbering the rows of files in the order in which the files hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from revana.workspace import materialise

FILE, BLOCK, PLACE = "_file", "_block", "_place"


def origin() -> list[Column]:
    """File and block that a row of a file scan comes from. Only a scan has them,
    so ask for them where the files are read."""
    return [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK)]


def number_rows(rows: DataFrame, out: str = "seq") -> DataFrame:
    """``rows`` with their dense number from 0, by file name, then place in the file.

    ``rows`` carry ``origin`` and come from the scan by narrow steps alone
    (filters, explodes, expressions), which keep a block's rows together and in
    order. Each row's place among those of its task is written with it, so that
    a task that runs again, on another split of the files, changes nothing. A
    block's first place and its number of rows then give its rows their numbers:
    only a table of one row per block is ordered, in even ranges, and the rows
    themselves are not sorted. An empty scan gives an empty table. Files should
    be large: a file of its own for every few rows makes the table of blocks as
    long as the data.
    """
    placed = materialise(rows.withColumn(PLACE, F.monotonically_increasing_id()), "ingested")
    key = [FILE, BLOCK]
    blocks = placed.groupBy(*key).agg(F.min(PLACE).alias("_first"), F.max(PLACE).alias("_last"),
                                      F.count(F.lit(1)).alias("_n"))
    ranged = materialise(blocks.repartitionByRange(*key).withColumn("_range", F.spark_partition_id()), "blocks")
    if not ranged.filter("_last - _first + 1 <> _n").isEmpty():
        raise ValueError("the rows were shuffled between the scan and their numbering")
    before = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    # As many rows as there were ranges.
    starts = (ranged.groupBy("_range").agg(F.sum("_n").alias("_n"))
              .select("_range", F.coalesce(F.sum("_n").over(before(F.lit(0)).orderBy("_range")), F.lit(0)).alias("_start")))
    inside = F.coalesce(F.sum("_n").over(before("_range").orderBy(*key)), F.lit(0))
    offsets = (ranged.withColumn("_inside", inside).join(starts, "_range")
               .select(*key, (F.col("_start") + F.col("_inside") - F.col("_first")).alias("_shift")))
    return (placed.join(offsets, key)
            .withColumn(out, (F.col(PLACE) + F.col("_shift")).cast("long"))
            .drop(*key, PLACE, "_shift"))
