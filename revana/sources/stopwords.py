"""Stop word files: one word per line."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from revana.functions.text import BLANKS


def load_stopwords(spark: SparkSession, path: str, trim: bool = True,
                   missing_ok: bool | None = None) -> DataFrame:
    """Distinct entries of the file.

    ``trim=True`` strips each line and drops blank ones, and a missing file is
    an empty list. ``trim=False`` keeps lines as they are, so that a line with
    one space removes the token " ", and a missing file is an error.
    """
    missing_ok = trim if missing_ok is None else missing_ok
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if not missing_ok or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "word string")
    word = F.col("value")
    if trim:
        word = F.regexp_replace(word, f"^{BLANKS}|{BLANKS}$", "")
    words = lines.select(word.alias("word"))
    return (words.filter(F.col("word") != "") if trim else words).distinct()


def as_stopwords(spark: SparkSession, words: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")
