"""Keyword topics of good and bad comments, the sweep over topic counts, and
tables made from a stored topic document."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from revana.functions.scores import BAD, GOOD
from revana.operators import lda, terms, topics
from revana.operators.lookup import union_all
from revana.operators.tokens import tokenize
from revana.sources.tables import write_sheets
from revana.sources.topics import read_topic_document, topic_strings, write_topic_document
from revana.workspace import materialise

# Keys of the keyword document, comment classes and topic counts.
KEYWORD_CLASSES = (("positive_comments_topics", GOOD, 7), ("negative_comments_topics", BAD, 5))
SHEETS = {"positive_reviews_lda": "Positive_LDA", "negative_reviews_lda": "Negative_LDA"}


def comment_corpora(comments: DataFrame, id_col: str = "comment_id", mode: str = "raw",
                    classes=KEYWORD_CLASSES, **tokenizer) -> dict[str, lda.Corpus]:
    """One corpus per comment class, on unfiltered tokens. Other classes than
    the listed ones are left out."""
    wanted = comments.filter(F.col("comment_type").isin([c for _, c, _ in classes]))
    docs = tokenize(wanted, "content", mode, id_col=id_col, **tokenizer)
    docs = materialise(docs.select(id_col, "comment_type", "tokens"), "raw-tokens")
    return lda.build_corpora({key: docs.filter(F.col("comment_type") == kind) for key, kind, _ in classes}, id_col=id_col)


def keyword_topics(corpora: dict[str, lda.Corpus], stop: DataFrame | None = None,
                   classes=KEYWORD_CLASSES, passes: int = 10, seed: int = 42,
                   n: int = 50) -> DataFrame:
    """Rows (cls, topic_name, words)."""
    models = lda.fit_models({key: (corpora[key], k) for key, _, k in classes}, seed, passes)
    return topics.topic_keywords(union_all([m.terms(key, n) for key, m in models.items()]), stop, n)


def write_keyword_topics(comments: DataFrame, stop: DataFrame, path: str, **options) -> None:
    corpora = comment_corpora(comments, **options)
    write_topic_document(keyword_topics(corpora, stop), "words", path)
    for corpus in corpora.values():
        corpus.release()


def topic_count_sweep(comments: DataFrame, ks: Iterable[int] = range(2, 11), passes: int = 10,
                      seed: int = 42, **options) -> DataFrame:
    corpora = comment_corpora(comments, **options)
    table = lda.sweep_topics(corpora, ks, passes, seed)
    for corpus in corpora.values():
        corpus.release()
    return table


def topic_table(spark: SparkSession, document: str, classes: dict[str, str] = SHEETS) -> DataFrame:
    """Rows (sheet, topic, weight, word) of a stored document of topic texts."""
    strings = topic_strings(read_topic_document(spark, document), classes)
    return topics.parse_topics(strings).select(
        F.col("cls").alias("sheet"), F.col("topic_name").alias("Topic"),
        F.col("weight").alias("Weight"), F.col("word").alias("Word"))


def topic_sheets(spark: SparkSession, document: str, out: str, fmt: str = "parquet") -> None:
    write_sheets(topic_table(spark, document), out, fmt=fmt)


def topic_cloud(spark: SparkSession, document: str, cls: str = "positive_reviews_lda",
                k: int = 200) -> DataFrame:
    """The heaviest words of one class over all its topics."""
    parsed = topics.parse_topics(topic_strings(read_topic_document(spark, document), {cls: cls}))
    return terms.cloud_weights(
        topics.topic_weight_by_word(parsed).drop("cls"), k, weight="weight")
