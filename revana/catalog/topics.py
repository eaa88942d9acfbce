"""Topic term tables. The topics here are the languages of a score class, with
word shares as weights, so that SQL can check everything done after a model.
The models themselves are in ``models``."""

from __future__ import annotations

from pyspark.sql import functions as F

from revana.catalog.base import BASE, STOPS, WORDS, all_reviews, query, r6, scored_reviews, sql, tokens
from revana.functions.scores import BAD, GOOD, comment_class
from revana.functions.wordlists import DEFAULT
from revana.operators import topics
from revana.operators.tokens import word_rows
from revana.sources.stopwords import as_stopwords
from revana.sources.topics import (read_topic_document, topic_strings, topic_word_lists,
                                   write_topic_document)
from revana.workspace import materialise, run_dir

# Class keys of the topic documents.
POSITIVE, NEGATIVE = "positive_reviews_lda", "negative_reviews_lda"
KEYWORDS = {POSITIVE: "positive_comments_topics", NEGATIVE: "negative_comments_topics"}
_LANGS = ("de", "en", "es", "fr")
_CLASSES = {POSITIVE: "score = 5", NEGATIVE: "score < 3"}


def _rows(spark, sf):
    topic = F.array_position(F.array(*[F.lit(x) for x in _LANGS]), F.col("lang")) - 1
    return word_rows(tokens(topics.label_classes(scored_reviews(spark, sf), _CLASSES)),
                     "cls", topic.cast("int").alias("topic"))


def terms(spark, sf, n=50):
    return topics.word_shares(_rows(spark, sf), n)


def _short(df):
    return df.withColumn("weight", r6("weight"))


_ROWS = f"""topic_rows AS (SELECT CASE WHEN score = 5 THEN '{POSITIVE}' ELSE '{NEGATIVE}' END AS cls,
    CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS topic, word
  FROM words WHERE score = 5 OR score < 3)"""
_SHARES = """shares AS (SELECT cls, topic, word,
    n / sum(n) OVER (PARTITION BY cls, topic) AS weight,
    row_number() OVER (PARTITION BY cls, topic ORDER BY n DESC, word) AS rank
  FROM (SELECT cls, topic, word, count(*) AS n FROM topic_rows GROUP BY cls, topic, word))"""
_TOP = "top50 AS (SELECT * FROM shares WHERE rank <= 50)"
_BEST = """best AS (SELECT * EXCLUDE (b) FROM (SELECT *,
    row_number() OVER (PARTITION BY cls, word ORDER BY weight DESC, topic) AS b FROM top50) WHERE b = 1)"""
_EXCLUSIVE = """exclusive AS (SELECT cls, topic, word, weight,
    row_number() OVER (PARTITION BY cls, topic ORDER BY weight DESC, rank) AS rank FROM best)"""
_STRINGS = """strings AS (SELECT cls, 'topic_' || topic AS topic_name,
    string_agg(printf('%.3f*''%s''', weight, word), ' + ' ORDER BY rank) AS topic_string
  FROM exclusive GROUP BY cls, topic)"""
_TERMS = [*BASE, WORDS, _ROWS, _SHARES, _TOP]
_ALL = [*_TERMS, _BEST, _EXCLUSIVE, _STRINGS]


def _select(name):
    return f"""SELECT cls, CAST(topic AS INTEGER) AS topic, CAST(rank AS INTEGER) AS rank, word,
  round(weight, 6) AS weight FROM {name}"""


@query(sql(BASE[0], """SELECT comment_id, content, comment_type FROM (SELECT *,
  CASE WHEN score_raw >= 4 THEN '好评' WHEN score_raw = 3 THEN '中评' ELSE '差评' END AS comment_type
  FROM reviews) WHERE comment_type <> '中评'"""))
def split_by_class(spark, sf):
    df = all_reviews(spark, sf).select(
        "comment_id", "content", comment_class(F.col("score")).alias("comment_type"))
    return df.filter(F.col("comment_type").isin(GOOD, BAD))


@query(sql(*BASE[:2], f"""SELECT comment_id, content, '{POSITIVE}' AS cls FROM dedup WHERE score = 5
UNION ALL SELECT comment_id, content, '{NEGATIVE}' FROM dedup WHERE score < 3"""))
def split_by_score(spark, sf):
    return topics.label_classes(scored_reviews(spark, sf), _CLASSES).select(
        "comment_id", "content", "cls")


@query(sql(*_TERMS, _select("top50")))
def topic_terms(spark, sf):
    return _short(topics.top_terms(terms(spark, sf, 80)).select("cls", "topic", "rank", "word", "weight"))


@query(sql(*_ALL, _select("best")))
def best_topics(spark, sf):
    return _short(topics.best_topics(terms(spark, sf)))


@query(sql(*_ALL, _select("exclusive")))
def exclusive_terms(spark, sf):
    return _short(topics.exclusive_terms(terms(spark, sf)))


@query(sql(*_ALL, "SELECT cls, topic_name, topic_string FROM strings"))
def topic_texts(spark, sf):
    return topics.format_topics(topics.exclusive_terms(terms(spark, sf)))


@query(sql(*_ALL, "SELECT cls, topic_name, topic_string FROM strings"))
def topic_document(spark, sf):
    """Nested document written and read back."""
    path = run_dir(spark, "topics")
    write_topic_document(topics.format_topics(topics.exclusive_terms(terms(spark, sf))),
                         "topic_string", path)
    return topic_strings(read_topic_document(spark, path), {POSITIVE: POSITIVE, NEGATIVE: NEGATIVE,
                                                            "no_such_class": "none"})


_PARSED = r"""parsed AS (SELECT cls, topic_name, CAST(i - 1 AS INTEGER) AS pos,
    CAST(regexp_extract(part, '([\d\.]+)\*''([^'']+)''', 1) AS DOUBLE) AS weight,
    regexp_extract(part, '([\d\.]+)\*''([^'']+)''', 2) AS word
  FROM (SELECT cls, topic_name, trim(unnest(string_split(topic_string, '+'))) AS part,
          generate_subscripts(string_split(topic_string, '+'), 1) AS i FROM strings))"""


@query(sql(*_ALL, _PARSED, "SELECT cls, topic_name, pos, weight, word FROM parsed"))
def parsed_topics(spark, sf):
    return topics.parse_topics(topic_texts(spark, sf))


@query(sql(*_ALL, _PARSED, """SELECT cls, word, round(sum(weight), 6) AS weight FROM parsed GROUP BY cls, word"""))
def topic_word_weights(spark, sf):
    """Summed from the parsed topic texts."""
    return _short(topics.topic_weight_by_word(parsed_topics(spark, sf)))


@query(sql(*_TERMS, _select("top50")))
def stacked_topics(spark, sf):
    """Two tables, one per class, put under each other."""
    stored = materialise(terms(spark, sf), "topic-terms")
    return _short(topics.stack_classes(**{
        c: stored.filter(F.col("cls") == c).drop("cls") for c in (POSITIVE, NEGATIVE)}))


@query(sql(*_TERMS, """SELECT cls, word, round(sum(weight), 6) AS weight FROM top50 GROUP BY cls, word"""))
def topic_word_weights_shared(spark, sf):
    """The same over lists in which words repeat between topics."""
    return _short(topics.topic_weight_by_word(terms(spark, sf)))


_KEY = "CASE cls " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KEYWORDS.items()) + " END"


@query(sql(*_TERMS, STOPS, f"""SELECT {_KEY} AS cls, 'Topic_' || (topic + 1) AS topic_name,
  string_agg(word, ' ' ORDER BY rank) AS words FROM top50
WHERE word NOT IN (SELECT word FROM stops) GROUP BY cls, topic"""))
def topic_keywords(spark, sf):
    """Keyword lists, as nested document written and read back."""
    path = run_dir(spark, "keywords")
    rename = F.create_map([F.lit(x) for pair in KEYWORDS.items() for x in pair])
    lists = topics.topic_keywords(
        terms(spark, sf).withColumn("cls", rename[F.col("cls")]), as_stopwords(spark, DEFAULT))
    write_topic_document(lists, "words", path)
    return (topic_word_lists(read_topic_document(spark, path))
            .withColumn("words", F.array_join("words", " ")))
