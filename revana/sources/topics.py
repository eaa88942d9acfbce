"""Nested topic documents: class -> topic -> text or word list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from revana.schemas import TOPIC_KEYWORDS, TOPIC_STRINGS


def topic_document(rows: DataFrame, value_col: str) -> DataFrame:
    """One row with the JSON text of (cls, topic_name, value). A topic model has
    few topics, so the document is small whatever the corpus."""
    entry = F.struct("topic_name", value_col)
    per_class = rows.groupBy("cls").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("topics"))
    return per_class.agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("cls", "topics")))).alias("value"))


def write_topic_document(rows: DataFrame, value_col: str, path: str) -> None:
    topic_document(rows, value_col).write.mode("overwrite").text(path)


def read_topic_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def topic_strings(doc: DataFrame, classes: dict[str, str] | None = None,
                  body_col: str = "value") -> DataFrame:
    """Rows (cls, topic_name, topic_string). ``classes`` picks keys of the
    document and may rename them; a key the document lacks gives no row."""
    return _entries(doc, body_col, TOPIC_STRINGS, "topic_string", classes)


def topic_word_lists(doc: DataFrame, classes: dict[str, str] | None = None,
                     body_col: str = "value") -> DataFrame:
    """Rows (cls, topic_name, words)."""
    return _entries(doc, body_col, TOPIC_KEYWORDS, "words", classes)


def _entries(doc, body_col, schema, value_col, classes):
    rows = (doc.select(F.explode(F.from_json(body_col, schema)).alias("cls", "topics"))
            .select("cls", F.explode("topics").alias("topic_name", value_col)))
    if classes is None:
        return rows
    rename = F.create_map([F.lit(x) for pair in classes.items() for x in pair])
    return rows.filter(F.col("cls").isin(list(classes))).withColumn("cls", rename[F.col("cls")])
