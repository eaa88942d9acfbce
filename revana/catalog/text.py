"""Cleaning and tokenising."""

from __future__ import annotations

from pyspark.sql import functions as F

from revana.catalog.base import (BASE, STOP_LIST, deduplicated_tokens,
                                 documents, query, r6, sql, table)
from revana.functions.scores import sharpen, to_number
from revana.functions.text import join_tokens, keep_script, or_missing, strip_controls
from revana.operators.tokens import tokenize, word_rows
from revana.sources.stopwords import as_stopwords

# Letter groups frequent in the test texts, as a lexicon.
LEXICON = ("the of de and to in la der is that en it for was on die with que le as be des by this "
           "und et are er at re from an th les un es el ha nd ou he den st von ed ti ing or tion "
           "ea nt ly ment eau eaux pour ent ing ble ther tionst une ter").split()


@query("""SELECT doc_id, regexp_replace(lower(text), '[^a-z]', ' ', 'g') AS clean_text FROM documents""")
def script_only(spark, sf):
    """Everything outside the script becomes a blank, as languages with spaces need."""
    return documents(spark, sf).select(
        "doc_id", keep_script(F.lower("text"), "a-z", " ").alias("clean_text"))


@query("""SELECT doc_id, replace(text, 'e', '') AS text, lang, source, n_chars FROM documents""")
def controls_stripped(spark, sf):
    """The texts hold no control characters, so one takes the place of a letter."""
    dirty = documents(spark, sf).withColumn("text", F.replace("text", F.lit("e"), F.lit("\x07")))
    return strip_controls(dirty)


def _digest(df):
    return df.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                     F.md5(F.array_join("tokens", "|")).alias("digest"))


def _sql_digest(tokens, source="documents", text="text"):
    return f"""SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, '|')) AS digest
FROM (SELECT doc_id, {tokens.format(text)} AS t FROM {source})"""


@query(_sql_digest(r"regexp_extract_all(lower({}), '\p{{L}}+')"))
def letter_words(spark, sf):
    return _digest(tokenize(documents(spark, sf), "text"))


@query(_sql_digest(r"regexp_extract_all(lower({}), '\p{{L}}+|\P{{L}}')"))
def raw_words(spark, sf):
    return _digest(tokenize(documents(spark, sf), "text", "raw"))


@query(_sql_digest(r"list_filter(regexp_split_to_array({}, '[\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]+'), lambda w: w <> '')"))
def blank_words(spark, sf):
    return _digest(tokenize(documents(spark, sf), "text", "blanks"))


@query(sql(r"""runs AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS run
FROM documents)""", """grams AS (SELECT doc_id, substr(run, CAST(i AS INTEGER), 2) AS gram
FROM (SELECT doc_id, run, unnest(range(1, length(run))) AS i FROM runs))""",
           "SELECT doc_id, gram, count(*) AS n FROM grams GROUP BY doc_id, gram"))
def script_bigrams(spark, sf):
    """The n-gram tokenizer with the Latin script in place of Han."""
    df = tokenize(documents(spark, sf).withColumn("text", F.lower("text")), "text", "ngram",
                  char_class="a-z")
    return (word_rows(df, "doc_id").withColumnRenamed("word", "gram")
            .groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("n")))


@query(_sql_digest("regexp_extract_all(lower({}), '"
                   + "|".join(sorted(LEXICON, key=len, reverse=True)) + "|(?s:.)')"))
def lexicon_words(spark, sf):
    """Greedy longest match; alternatives sorted by length are the same in SQL."""
    df = documents(spark, sf).withColumn("text", F.lower("text"))
    return _digest(tokenize(df, "text", "lexicon", lexicon=as_stopwords(spark, LEXICON)))


@query(_sql_digest(r"regexp_extract_all(lower({}), '\p{{L}}+|\P{{L}}')"))
def dictionary_words(spark, sf):
    """A lexicon of dictionary size: all words of the texts. The longest match at
    the start of a word is then the word."""
    df = documents(spark, sf).withColumn("text", F.lower("text"))
    words = word_rows(tokenize(df, "text")).distinct()
    return _digest(tokenize(df, "text", "lexicon", lexicon=words))


@query(sql(*BASE, f"""SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS clean_text
FROM (SELECT doc_id, list_filter(tokens, lambda w: w NOT IN ({STOP_LIST})) AS t FROM toks)"""))
def stopwords_removed(spark, sf):
    return deduplicated_tokens(spark, sf, stop=True).select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
        join_tokens("tokens").alias("clean_text"))


@query("""SELECT l_orderkey, l_linenumber, round(r, 6) AS raw,
  round(sqrt(r) / (sqrt(r) + sqrt(1 - r)), 6) AS adjusted
FROM (SELECT l_orderkey, l_linenumber, least(l_discount * 10, 1.0) AS r FROM lineitem)""")
def power_transform(spark, sf):
    r = F.least(F.col("l_discount") * 10, F.lit(1.0))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(r).alias("raw"), r6(sharpen(r)).alias("adjusted"))


@query("""SELECT event_id, CASE WHEN regexp_matches(v, '^[0-9]+$') THEN CAST(v AS DOUBLE) ELSE 0 END AS score
FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN regexp_extract(props, '([0-9]+)', 1)
                            WHEN event_type = 'view' THEN props END AS v FROM events)""")
def coerced_numbers(spark, sf):
    """Numbers as text, text that is no number, and nulls."""
    v = (F.when(F.col("event_type") == "click", F.regexp_extract("props", "([0-9]+)", 1))
         .when(F.col("event_type") == "view", F.col("props")))
    return table(spark, sf, "events").select("event_id", to_number(v).alias("score"))


@query("""SELECT coalesce(CAST(quality AS VARCHAR), 'missing') AS quality, count(*) AS n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def missing_as_text(spark, sf):
    return (table(spark, sf, "documents").select("doc_id")
            .join(table(spark, sf, "labels"), "doc_id", "left")
            .groupBy(or_missing(F.col("quality")).alias("quality"))
            .agg(F.count(F.lit(1)).alias("n")))
