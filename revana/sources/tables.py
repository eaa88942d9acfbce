"""Readers and writers of comment, table and survey files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from revana.functions.text import strip_controls
from revana.operators.sequence import number_rows, origin
from revana.schemas import COMMENT, SEQ

_CSV = {"header": True, "escape": '"', "encoding": "UTF-8"}


def read_comments(spark: SparkSession, path: str, array_file: bool = False, seq: str | None = None) -> DataFrame:
    """Comment JSON: line files, or one JSON array per file (``array_file``).

    An array file is a single task; keep big stores as lines or Parquet. The
    fixed schema also supplies a ``score`` column the file does not have.

    ``seq="stored"`` also reads the ingest sequence that ``collect_comments``
    stores; ``seq="file"`` numbers the comments from 0 by file and place in it,
    for stores without one. Either way it is column ``seq``.
    """
    if seq not in (None, "stored", "file"):
        raise ValueError(f"seq is 'stored' or 'file', not {seq!r}")
    schema = COMMENT if seq != "stored" else T.StructType([*COMMENT.fields, SEQ])
    comments = spark.read.schema(schema).option("multiLine", array_file).json(path)
    if seq == "file":
        comments = number_rows(comments.select("*", *origin()))
    return default_score(comments)


def default_score(df: DataFrame, col: str = "score", missing: float = 0) -> DataFrame:
    """Missing scores become ``missing``; so does a missing column."""
    if col not in df.columns:
        return df.withColumn(col, F.lit(missing))
    kind = df.schema[col].dataType
    return df.withColumn(col, F.coalesce(col, F.lit(missing).cast(kind)))


def write_comments(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Cleaned single table. CSV for people, Parquet for what is read again."""
    writer = strip_controls(df).write.mode("overwrite")
    writer.options(**_CSV).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               line_breaks: bool = False) -> DataFrame:
    """Table or survey file in CSV. Give a schema where one is known: inferring
    it reads the data twice. ``line_breaks`` admits them inside cells."""
    reader = spark.read.options(**_CSV, multiLine=line_breaks)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def write_sheets(df: DataFrame, path: str, sheet_col: str = "sheet", fmt: str = "parquet") -> None:
    """One folder per sheet."""
    strip_controls(df).write.mode("overwrite").partitionBy(sheet_col).format(fmt).save(path)


def write_records(df: DataFrame, path: str) -> None:
    """JSON records, text kept as UTF-8."""
    df.write.mode("overwrite").json(path)
