"""The page parser on a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from revana.sources.pages import parse_comment_pages


def stream_pages(spark: SparkSession, folder: str, max_files: int | None = None,
                 one_per_line: bool = False) -> DataFrame:
    """Pages as they arrive in ``folder``, one per file or one per line."""
    reader = spark.readStream.option("wholetext", not one_per_line)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(folder)


def stream_comments(spark: SparkSession, folder: str, out: str, checkpoint: str,
                    max_files: int | None = None, one_per_line: bool = False,
                    **parse) -> StreamingQuery:
    """Append the comments of all pages present to Parquet ``out``, then stop."""
    comments = parse_comment_pages(stream_pages(spark, folder, max_files, one_per_line), **parse)
    return (comments.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).option("path", out)
            .trigger(availableNow=True).start())
