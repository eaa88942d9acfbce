"""Topic term tables: (cls, topic, word, weight), their ranking and text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

_PAIR = r"([\d\.]+)\*'([^']+)'"


def word_shares(rows: DataFrame, n: int = 50, by: tuple[str, ...] = ("cls", "topic")) -> DataFrame:
    """Topic terms without a model: from rows (``by``, word), the share of each
    word in its group, for the ``n`` most frequent words.

    The share keeps the order of the count, so the cut comes first and the
    totals are joined to what is left.
    """
    by = list(by)
    counts = rows.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    first = W.partitionBy(*by).orderBy(F.desc("n"), "word")
    return (counts.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n)
            .join(totals, by)
            .select(*by, "rank", "word", (F.col("n") / F.col("total")).alias("weight")))


def top_terms(terms: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` heaviest words of each topic, ranked from 1."""
    heavy = W.partitionBy("cls", "topic").orderBy(F.desc("weight"), "word")
    return terms.withColumn("rank", F.row_number().over(heavy)).filter(F.col("rank") <= n)


def best_topics(terms: DataFrame) -> DataFrame:
    """The one topic of its class in which each word weighs most; the lower
    topic on ties. Apply to the cut lists: words below the cut do not compete."""
    best = W.partitionBy("cls", "word").orderBy(F.desc("weight"), "topic")
    return terms.withColumn("_b", F.row_number().over(best)).filter("_b = 1").drop("_b")


def exclusive_terms(terms: DataFrame, n: int = 50) -> DataFrame:
    """Cut to ``n``, leave each word to its best topic, rank again."""
    kept = best_topics(top_terms(terms, n))
    again = W.partitionBy("cls", "topic").orderBy(F.desc("weight"), "rank")
    return kept.withColumn("rank", F.row_number().over(again))


def format_topics(terms: DataFrame) -> DataFrame:
    """Rows (cls, topic_name, topic_string), e.g. ``topic_0`` and
    ``0.034*'a' + 0.014*'b'``. The lists were cut before, so a group is small."""
    entry = F.struct("rank", F.format_string("%.3f*'%s'", "weight", "word").alias("s"))
    return (terms.groupBy("cls", F.format_string("topic_%d", "topic").alias("topic_name"))
            .agg(F.array_join(F.array_sort(F.collect_list(entry))["s"], " + ")
                 .alias("topic_string")))


def parse_topics(strings: DataFrame) -> DataFrame:
    """Rows (cls, topic_name, pos, weight, word) of topic strings. A part that
    is not a weight and a quoted word is skipped."""
    part = F.trim("part")
    return (strings.select("cls", "topic_name",
                           F.posexplode(F.split("topic_string", r"\+")).alias("pos", "part"))
            .select("cls", "topic_name", "pos",
                    F.regexp_extract(part, _PAIR, 1).try_cast("double").alias("weight"),
                    F.regexp_extract(part, _PAIR, 2).alias("word"))
            .filter((F.col("word") != "") & F.col("weight").isNotNull()))


def topic_keywords(terms: DataFrame, stop: DataFrame | None = None, n: int = 50) -> DataFrame:
    """Rows (cls, topic_name, words) with ``Topic_1`` for topic 0. Stop words go
    after the cut, so that lists may be shorter than ``n``."""
    cut = top_terms(terms, n)
    if stop is not None:
        cut = cut.join(stop.select("word").distinct(), "word", "left_anti")
    return (cut.groupBy("cls", F.format_string("Topic_%d", F.col("topic") + 1).alias("topic_name"))
            .agg(F.array_sort(F.collect_list(F.struct("rank", "word")))["word"].alias("words")))


def topic_weight_by_word(terms: DataFrame) -> DataFrame:
    """Summed weight of each word over the topics of its class."""
    return terms.groupBy("cls", "word").agg(F.sum("weight").alias("weight"))


def label_classes(df: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Rows that meet one of the SQL conditions, under a ``cls`` column: several
    filters and their union in a single pass. The first condition met counts."""
    cls = F.lit(None).cast("string")
    for name, condition in reversed(classes.items()):
        cls = F.when(F.expr(condition), name).otherwise(cls)
    return df.withColumn("cls", cls).filter(F.col("cls").isNotNull())


def stack_classes(**tables: DataFrame) -> DataFrame:
    """Union of tables under a ``cls`` column holding their argument names."""
    parts = [t.withColumn("cls", F.lit(name)) for name, t in tables.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
