"""Stored pages to a comment store, and a comment store to a table file."""

from __future__ import annotations

from pyspark.sql import SparkSession

from revana.sources.pages import CALLBACK, ID_PREFIX, parse_comment_pages, read_pages
from revana.sources.tables import read_comments, write_comments, write_table
from revana.workspace import scope


def collect_comments(spark: SparkSession, pages: str, out: str, one_per_line: bool = False,
                     callback: str = CALLBACK, id_prefix: str = ID_PREFIX,
                     fmt: str = "json") -> None:
    """Parse all pages under ``pages``. ``fmt="parquet"`` partitions the store by
    comment class, so that work on one class reads only that class.

    The store has the comments' ingest sequence ``seq``: first-wins deduplication
    by it keeps what was collected first, whatever the ids, which may repeat or be absent.
    """
    with scope(spark):
        comments = parse_comment_pages(read_pages(spark, pages, one_per_line),
                                       callback=callback, id_prefix=id_prefix, seq="seq")
        if fmt == "json":
            write_comments(comments, out)
        else:
            comments.write.mode("overwrite").partitionBy("comment_type").format(fmt).save(out)


def export_comments(spark: SparkSession, comments: str, out: str, array_file: bool = False,
                    fmt: str = "csv") -> None:
    """Comment JSON to a cleaned table file. A missing input is an error."""
    write_table(read_comments(spark, comments, array_file), out, fmt)
