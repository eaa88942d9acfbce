"""Stored comment pages to comment rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from revana.functions.scores import comment_class, to_number
from revana.operators.sequence import BLOCK, FILE, number_rows, origin
from revana.schemas import PAGE

# Callback of the stored pages and prefix of the comment ids.
CALLBACK = "fetchJSON_comment98"
ID_PREFIX = "jd"

_WRAPPED = ("page struct<" + ",".join(
    f"{f.name}:{f.dataType.simpleString()}" for f in PAGE.fields) + ">, broken string")


def read_pages(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """One row per stored page, in column ``value``, with the file and block it
    comes from. Pages hold no line break, so a large store should keep many per
    file, one on each line."""
    return spark.read.text(path, wholetext=not one_per_line).select("value", *origin())


def parse_comment_pages(pages: DataFrame, body_col: str = "value",
                        callback: str = CALLBACK, id_prefix: str = ID_PREFIX,
                        seq: str | None = None) -> DataFrame:
    """Unwrap the JSON of each page and return its comments.

    A page without the callback, or whose JSON is bad, yields nothing. Spark's
    JSON reader stops after the first value and would accept trailing junk. It
    cannot do so for both ``{"page": X}`` and ``[X]`` unless X is one whole
    value, so both readings must succeed.

    Narrow and stateless, hence valid on a stream as well. With ``seq``, for pages
    of ``read_pages``, a column of that name numbers the comments from 0: by file,
    page in the file and place in the page. Bad pages take no numbers.
    """
    at = [FILE, BLOCK] if seq else []
    body = F.regexp_extract(body_col, re.escape(callback) + r"\(([^\n]*)\)", 1)
    parsed = F.from_json(
        F.concat(F.lit('{"page":'), body, F.lit("}")), _WRAPPED,
        {"columnNameOfCorruptRecord": "broken", "allowSingleQuotes": "false"})
    one_value = F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1
    comments = comments_with_defaults(
        pages.select(*at, parsed.alias("p"), one_value.alias("one_value"))
        .filter(F.col("one_value") & F.col("p.broken").isNull())
        .select(*at, F.explode("p.page.comments").alias("c")).select(*at, "c.*"), id_prefix, at)
    return number_rows(comments, seq) if seq else comments


def comments_with_defaults(raw: DataFrame, id_prefix: str = ID_PREFIX, keep: list[str] | tuple = ()) -> DataFrame:
    """Prefix the id, fill absent fields and classify by score."""
    score = to_number(F.col("score"))
    return raw.select(
        *keep,
        F.concat(F.lit(id_prefix), F.coalesce("id", F.lit(""))).alias("comment_id"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("creationTime", F.lit("")).alias("creation_time"),
        score.alias("score"),
        comment_class(score).alias("comment_type"),
    )


def as_pages(comments: DataFrame, page_col: str, callback: str = CALLBACK, order: str = "id") -> DataFrame:
    """Inverse of the parser: wrap the rows of each page (a fixed, small number
    per page), sorted by ``order``, in the callback. Columns: id, content,
    creationTime, score."""
    record = F.struct("id", "content", "creationTime", "score")
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("by"), record.alias("record"))))
    return comments.groupBy(page_col).agg(
        F.concat(F.lit(callback + "("),
                 F.to_json(F.struct(F.transform(rows, lambda r: r["record"]).alias("comments"))),
                 F.lit(")")).alias("value"))
