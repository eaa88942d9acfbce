"""Pages, comment files, stop word files and table files."""

from __future__ import annotations

from pyspark.sql import functions as F

from revana.catalog.base import (BASE, COUNTED, REVIEWS, contents, deduplicated_tokens, query,
                                 reviews, sql, table)
from revana.functions.scores import comment_class
from revana.functions.text import letter_tokens
from revana.operators.dedup import dedup_first
from revana.operators.terms import word_frequency
from revana.operators.tokens import word_rows
from revana.sources.pages import CALLBACK, as_pages, parse_comment_pages
from revana.sources.stopwords import load_stopwords
from revana.sources.tables import (default_score, read_comments, read_table, write_comments,
                                   write_sheets, write_table)
from revana.streaming.pages import stream_comments
from revana.workspace import run_dir


def _pages(spark, sf):
    records = reviews(spark, sf).select(
        F.expr("doc_id div 20").alias("page"), F.col("doc_id").alias("id"), "content",
        F.concat(F.lit("t"), "doc_id").alias("creationTime"), F.col("score_raw").alias("score"))
    return as_pages(records, "page").select("value")


def _comments(df):
    return df.select("comment_id", "content", "creation_time", "score", "comment_type")


_COMMENTS = """SELECT concat('jd', doc_id) AS comment_id, content,
  concat('t', doc_id) AS creation_time, CAST(coalesce(score_raw, 0) AS DOUBLE) AS score,
  CASE WHEN score_raw >= 4 THEN '好评' WHEN score_raw = 3 THEN '中评' ELSE '差评' END AS comment_type
FROM reviews"""


@query(sql(REVIEWS, _COMMENTS))
def parse_pages(spark, sf):
    """Every page is also given cut short, with trailing junk, with a second
    value and under another callback; none of these may yield a row."""
    page = _pages(spark, sf)
    v = F.col("value")
    variants = F.array(
        v, F.expr("substr(value, 1, length(value) - 4)"),
        F.regexp_replace(v, r"\)$", " junk)"), F.regexp_replace(v, r"\)$", ', {"comments":[]})'),
        F.regexp_replace(v, r"\)$", "}, {)"), F.regexp_replace(v, CALLBACK, "otherCallback"))
    return parse_comment_pages(page.select(F.explode(variants).alias("value")))


@query(sql(REVIEWS, _COMMENTS))
def stream_parsed_pages(spark, sf):
    """The same parser on a file stream, one page per line."""
    inbox, out = run_dir(spark, "inbox"), run_dir(spark, "comments")
    _pages(spark, sf).write.text(inbox)
    stream_comments(spark, inbox, out, run_dir(spark, "stream-state"),
                    one_per_line=True).awaitTermination()
    return _comments(spark.read.parquet(out))


@query(sql(REVIEWS, _COMMENTS))
def comment_file(spark, sf):
    """Written as JSON and read back."""
    path = run_dir(spark, "comment-json")
    write_comments(parse_comment_pages(_pages(spark, sf)), path)
    return read_comments(spark, path)


@query(sql(REVIEWS, "SELECT comment_id, coalesce(score_raw, 0) AS score FROM reviews"))
def default_scores(spark, sf):
    return default_score(reviews(spark, sf).select("comment_id", F.col("score_raw").alias("score")))


@query(sql(REVIEWS, """SELECT comment_type, count(*) AS n FROM (
  SELECT CASE WHEN coalesce(score_raw, 0) >= 4 THEN '好评' WHEN score_raw = 3 THEN '中评'
         ELSE '差评' END AS comment_type FROM reviews) GROUP BY comment_type"""))
def comment_classes(spark, sf):
    scored = default_score(reviews(spark, sf).select(F.col("score_raw").alias("score")))
    return (scored.groupBy(comment_class(F.col("score")).alias("comment_type"))
            .agg(F.count(F.lit(1)).alias("n")))


@query(sql(*COUNTED, "SELECT word, n FROM freq"))
def table_file(spark, sf):
    """Word frequencies written as CSV and read back."""
    path = run_dir(spark, "word-frequency")
    write_table(word_frequency(deduplicated_tokens(spark, sf)), path)
    return read_table(spark, path, "word string, n bigint")


@query(sql(*COUNTED[:-1], """SELECT concat('Words_', lang) AS sheet, word, count(*) AS n
FROM words GROUP BY lang, word"""))
def sheet_files(spark, sf):
    """One folder per sheet, here one sheet of word counts per language."""
    path = run_dir(spark, "sheets")
    counts = (word_rows(deduplicated_tokens(spark, sf), "lang")
              .groupBy(F.concat(F.lit("Words_"), "lang").alias("sheet"), "word")
              .agg(F.count(F.lit(1)).alias("n")))
    write_sheets(counts, path)
    return spark.read.parquet(path).select("sheet", "word", "n")


@query("""SELECT doc_id, lang, source, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)""")
def survey_file(spark, sf):
    """A survey table written as CSV and read with an inferred schema."""
    path = run_dir(spark, "survey")
    write_table(reviews(spark, sf).select("doc_id", "lang", "source", "n_chars", "quality"), path)
    inferred = read_table(spark, path)
    return inferred.select(F.col("doc_id").cast("bigint"), "lang", "source",
                           F.col("n_chars").cast("bigint"), "quality")


def _stop_file(spark, sf):
    """A word list with a blank line per item, and blanks around some words."""
    path = run_dir(spark, "stop-words")
    words = (table(spark, sf, "benchmark")
             .select(F.explode(F.concat(letter_tokens(F.col("text")), F.array(F.lit(" "))))
                     .alias("w")))
    words.select(F.when(F.length("w") > 4, F.concat(F.lit("  "), "w", F.lit("\t")))
                 .otherwise(F.col("w"))).write.text(path)
    return path


_STOP_LINES = r"""lines AS (SELECT CASE WHEN length(w) > 4 THEN '  ' || w || chr(9) ELSE w END AS line
  FROM (SELECT unnest(list_append(regexp_extract_all(lower(text), '\p{L}+'), ' ')) AS w FROM benchmark))"""


@query(sql(_STOP_LINES, r"""SELECT DISTINCT regexp_replace(line, '^\s+|\s+$', '', 'g') AS word
FROM lines WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''"""))
def stopword_file_trimmed(spark, sf):
    return load_stopwords(spark, _stop_file(spark, sf))


@query(sql(_STOP_LINES, "SELECT DISTINCT line AS word FROM lines"))
def stopword_file_raw(spark, sf):
    return load_stopwords(spark, _stop_file(spark, sf), trim=False)


@query(sql(*BASE[:2], "SELECT comment_id, doc_id, content FROM dedup"))
def dedup_reviews(spark, sf):
    return dedup_first(contents(spark, sf)).select("comment_id", "doc_id", "content")
