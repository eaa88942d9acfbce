"""Registry, table loaders and the SQL pieces the oracle queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from revana.functions.wordlists import DEFAULT
from revana.operators.dedup import dedup_first
from revana.operators.tokens import remove_stopwords, tokenize
from revana.sources.tables import default_score
from revana.workspace import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name."""
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


# ---- tables -----------------------------------------------------------------

def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id")


def contents(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews without their score: no join needed."""
    return documents(spark, sf).select(
        F.concat(F.lit("rv"), "doc_id").alias("comment_id"), "doc_id",
        F.col("text").alias("content"), "lang")


def raw_score() -> Column:
    q, t = F.col("quality"), F.col("toxic")
    return (F.when((q == 1) & (t == 0) & (F.col("doc_id") % 5 == 0), 4)
            .when((q == 1) & (t == 0), 5).when(q == 1, 3).when(t == 0, 2).when(t == 1, 1))


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the score that their labels imply; unlabelled ones have none."""
    return documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").select(
        F.concat(F.lit("rv"), "doc_id").alias("comment_id"), "doc_id",
        F.col("text").alias("content"), "lang", "source", "n_chars", "quality",
        raw_score().alias("score_raw"))


def scored_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Deduplicated reviews, a missing score counted as 0."""
    texts = dedup_first(documents(spark, sf), "text", "doc_id")
    joined = texts.join(table(spark, sf, "labels"), "doc_id", "left")
    return default_score(joined.select(
        F.concat(F.lit("rv"), "doc_id").alias("comment_id"), "doc_id",
        F.col("text").alias("content"), "lang", "source", "n_chars", "quality",
        raw_score().alias("score")))


def all_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Every review, repeated texts included, a missing score counted as 0."""
    return default_score(reviews(spark, sf).withColumnRenamed("score_raw", "score"))


def tokens(df: DataFrame, stop: bool = False) -> DataFrame:
    out = tokenize(df).drop("content")
    return remove_stopwords(out, DEFAULT) if stop else out


def deduplicated_tokens(spark: SparkSession, sf: str, stop: bool = False) -> DataFrame:
    return tokens(dedup_first(contents(spark, sf)), stop)


def r6(col: Column | str) -> Column:
    return F.round(col, 6)


# ---- SQL --------------------------------------------------------------------

REVIEWS = """reviews AS (
  SELECT concat('rv', doc_id) AS comment_id, doc_id, text AS content, lang, source, n_chars, quality,
         CASE WHEN quality = 1 AND toxic = 0 AND doc_id % 5 = 0 THEN 4
              WHEN quality = 1 AND toxic = 0 THEN 5
              WHEN quality = 1 THEN 3
              WHEN toxic = 0 THEN 2
              WHEN toxic = 1 THEN 1 END AS score_raw
  FROM documents LEFT JOIN labels USING (doc_id))"""

DEDUP = """dedup AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, coalesce(score_raw, 0) AS score,
           row_number() OVER (PARTITION BY content ORDER BY doc_id) AS rn FROM reviews)
  WHERE rn = 1)"""

TOKENS = r"""toks AS (
  SELECT * EXCLUDE (content), regexp_extract_all(lower(content), '\p{L}+') AS tokens FROM dedup)"""

STOP_LIST = ", ".join(f"'{w}'" for w in DEFAULT)
STOPS = f"stops AS (SELECT unnest([{STOP_LIST}]) AS word)"

WORDS = "words AS (SELECT * EXCLUDE (tokens), unnest(tokens) AS word FROM toks)"

FREQ = "freq AS (SELECT word, count(*) AS n FROM words GROUP BY word)"

BASE = [REVIEWS, DEDUP, TOKENS]
COUNTED = [*BASE, WORDS, FREQ]


def sql(*parts: str) -> str:
    """The last part is the query, those before it are its WITH clauses."""
    *ctes, body = parts
    recursive = "RECURSIVE " if any("_rec " in c for c in ctes) else ""
    return (f"WITH {recursive}" + ",\n".join(ctes) + "\n" if ctes else "") + body
