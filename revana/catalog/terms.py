"""Word counts, vocabulary and the word graph, over deduplicated reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from revana.catalog.base import (BASE, COUNTED, FREQ, STOPS, WORDS, deduplicated_tokens, query, r6,
                                 sql)
from revana.operators import terms
from revana.operators.tokens import (distinct_words, doc_terms, drop_stop_rows, term_ids,
                                     vocabulary)
from revana.sources.stopwords import as_stopwords
from revana.functions.wordlists import DEFAULT
from revana.workspace import materialise

_KEPT = "kept AS (SELECT * FROM words WHERE word NOT IN (SELECT word FROM stops))"
_KEPT_FREQ = FREQ.replace("FROM words", "FROM kept")
_STOPPED = [*BASE, WORDS, STOPS, _KEPT, _KEPT_FREQ]
_TOP30 = """top30 AS (SELECT word, n FROM freq WHERE length(word) > 1
  ORDER BY n DESC, word LIMIT 30)"""


def _frequency(spark, sf, stop=True):
    return terms.word_frequency(deduplicated_tokens(spark, sf, stop))


def _stored(spark, sf):
    """For reports that read the tokens more than once."""
    return materialise(deduplicated_tokens(spark, sf, stop=True).select("doc_id", "tokens"),
                       "tokens")


@query(sql(*_STOPPED, """SELECT (SELECT count(*) FROM dedup) AS n_reviews,
  (SELECT count(*) FROM kept) AS n_tokens"""))
def corpus_counts(spark, sf):
    return terms.corpus_counts(deduplicated_tokens(spark, sf, stop=True))


@query(sql(*COUNTED, "SELECT word, n FROM freq ORDER BY n DESC, word"))
def word_frequency(spark, sf):
    return terms.ordered(_frequency(spark, sf, stop=False))


@query(sql(*_STOPPED, "SELECT word, n FROM freq WHERE length(word) > 1"))
def meaningful_words(spark, sf):
    return terms.meaningful(_frequency(spark, sf))


@query(sql(*_STOPPED, "SELECT word, n FROM freq WHERE length(word) <= 1"))
def meaningless_words(spark, sf):
    return terms.meaningless(_frequency(spark, sf))


@query(sql(*_STOPPED, _TOP30, 'SELECT word AS "词语", n AS "频率" FROM top30'))
def top_words(spark, sf):
    return terms.top_words(terms.meaningful(_frequency(spark, sf))).toDF("词语", "频率")


@query(sql(*_STOPPED, """SELECT word, n, round(n / max(n) OVER (), 6) AS relative
FROM (SELECT * FROM freq WHERE length(word) > 1 ORDER BY n DESC, word LIMIT 1000)"""))
def cloud_weights(spark, sf):
    weights = terms.cloud_weights(terms.meaningful(_frequency(spark, sf)), 1000)
    return weights.withColumn("relative", r6("relative"))


@query(sql(*COUNTED, STOPS, "SELECT word, n FROM freq WHERE word NOT IN (SELECT word FROM stops)"))
def stop_rows_dropped(spark, sf):
    """Stop words as an anti-join on rows instead of a filter on arrays."""
    return drop_stop_rows(_frequency(spark, sf, stop=False), as_stopwords(spark, DEFAULT))


@query(sql(*BASE, WORDS, "SELECT DISTINCT doc_id, word FROM words"))
def words_per_review(spark, sf):
    return distinct_words(deduplicated_tokens(spark, sf))


@query(sql(*BASE, WORDS, "SELECT doc_id, word, count(*) AS n FROM words GROUP BY doc_id, word"))
def document_terms(spark, sf):
    return doc_terms(deduplicated_tokens(spark, sf))


_VOCAB = """vocab AS (SELECT row_number() OVER (ORDER BY md5(word), word) - 1 AS word_id, word, n
FROM freq)"""


@query(sql(*COUNTED, _VOCAB, "SELECT word_id, word, n FROM vocab"))
def word_ids(spark, sf):
    return vocabulary(deduplicated_tokens(spark, sf))


@query(sql(*COUNTED, _VOCAB, """SELECT doc_id, word_id, count(*) AS n
FROM words JOIN vocab USING (word) GROUP BY doc_id, word_id"""))
def bag_of_word_ids(spark, sf):
    tokens = materialise(deduplicated_tokens(spark, sf).select("doc_id", "tokens"), "tokens")
    return term_ids(doc_terms(tokens), materialise(vocabulary(tokens), "vocabulary"))


@query(sql(*_STOPPED, _TOP30, """SELECT doc_id, word FROM
(SELECT DISTINCT doc_id, word FROM kept) WHERE word IN (SELECT word FROM top30)"""))
def top_words_per_review(spark, sf):
    tokens = _stored(spark, sf)
    top = terms.top_words(terms.meaningful(terms.word_frequency(tokens)))
    return terms.only_words(distinct_words(tokens), top)


@query(sql(*_STOPPED, _TOP30, "SELECT word, n AS size FROM top30"))
def graph_nodes(spark, sf):
    return terms.cooccurrence_nodes(terms.meaningful(_frequency(spark, sf)))


@query(sql(*_STOPPED, _TOP30, """uniq AS (SELECT DISTINCT doc_id, word FROM kept
  WHERE word IN (SELECT word FROM top30))""", """SELECT a.word AS src, b.word AS dst,
  2 * count(*) AS weight, count(*) AS n_docs
FROM uniq a JOIN uniq b ON a.doc_id = b.doc_id AND a.word < b.word GROUP BY a.word, b.word"""))
def graph_edges(spark, sf):
    tokens = _stored(spark, sf)
    frequency = terms.meaningful(terms.word_frequency(tokens))
    return terms.cooccurrence_edges(tokens, frequency)


@query(sql(*_STOPPED, _TOP30.replace("30", "5000"), """uniq AS (SELECT DISTINCT doc_id, word FROM kept
  WHERE word IN (SELECT word FROM top5000))""", """edges AS (SELECT a.word AS src, b.word AS dst, count(*) AS n
FROM uniq a JOIN uniq b ON a.doc_id = b.doc_id AND a.word < b.word GROUP BY a.word, b.word)""",
           """SELECT src AS word, count(*) AS n_later, CAST(sum(2 * n) AS BIGINT) AS weight, max(n) AS most
FROM edges GROUP BY src"""))
def graph_degrees_5000(spark, sf):
    """The graph of 5,000 words, by word: its edges to words that come later, their
    weight, and the documents of the heaviest."""
    tokens = _stored(spark, sf)
    frequency = terms.meaningful(terms.word_frequency(tokens))
    edges = terms.cooccurrence_edges(tokens, frequency, 5000)
    return edges.groupBy(F.col("src").alias("word")).agg(
        F.count(F.lit(1)).alias("n_later"), F.sum("weight").alias("weight"), F.max("n_docs").alias("most"))
