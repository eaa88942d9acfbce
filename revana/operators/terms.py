"""Word counts, top words and the word co-occurrence graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from revana.operators.products import pair_counts
from revana.operators.tokens import word_rows

FEW_WORDS = 100     # whose selections by document are few enough to be counted as arrays


def corpus_counts(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_reviews"),
                  F.coalesce(F.sum(F.size(tokens).cast("long")), F.lit(0)).alias("n_tokens"))


def word_frequency(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Count of each word. Counted before the shuffle, so frequent words are
    cheap. Unordered; see ``ordered``."""
    return (word_rows(df, tokens=tokens)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def ordered(frequency: DataFrame) -> DataFrame:
    """Most frequent first, ties by word."""
    return frequency.orderBy(F.desc("n"), "word")


def meaningful(frequency: DataFrame, min_len: int = 2) -> DataFrame:
    return frequency.filter(F.length("word") >= min_len)


def meaningless(frequency: DataFrame, min_len: int = 2) -> DataFrame:
    """The words that ``meaningful`` removes."""
    return frequency.filter(F.length("word") < min_len)


def top_words(frequency: DataFrame, k: int = 30) -> DataFrame:
    return ordered(frequency).limit(k)


def cloud_weights(frequency: DataFrame, k: int = 200, weight: str = "n") -> DataFrame:
    """The ``k`` heaviest words and their weight relative to the heaviest."""
    top = frequency.orderBy(F.desc(weight), "word").limit(k)
    most = F.max(weight).over(W.orderBy(F.desc(weight)).rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing))
    return top.withColumn("relative", F.col(weight) / most)


def only_words(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Rows whose word is in a word table."""
    return rows.join(words.select("word"), "word", "left_semi")


def cooccurrence_nodes(frequency: DataFrame, k: int = 30) -> DataFrame:
    return top_words(frequency, k).select("word", F.col("n").alias("size"))


def cooccurrence_edges(df: DataFrame, frequency: DataFrame, k: int = 30,
                       tokens: str = "tokens") -> DataFrame:
    """Undirected edges between the ``k`` top words, ``src < dst``.

    ``n_docs`` is the number of documents holding both words. ``weight`` is
    twice that, since both orders of a pair are counted. For more than
    ``FEW_WORDS`` top words the pairs are the cells of a sparse product.
    """
    top = top_words(frequency, k)
    pairs = (word_pairs(df, _word_array(top), tokens) if k <= FEW_WORDS
             else pair_counts(df, [r.word for r in top.select("word").collect()], tokens))
    return pairs.select("src", "dst", (2 * F.col("n_docs")).alias("weight"), "n_docs")


def word_pairs(df: DataFrame, words: Column, tokens: str = "tokens") -> DataFrame:
    """Document count of each pair out of the words in an array.

    Documents with the same selection of words are counted together first; only
    the distinct selections are expanded to pairs. There is no self-join, and
    the documents themselves are not shuffled.
    """
    selections = (df.select(F.sort_array(F.array_intersect(F.array_distinct(tokens), words))
                            .alias("ws"))
                  .filter(F.size("ws") > 1)
                  .groupBy("ws").agg(F.count(F.lit(1)).alias("n")))
    return (selections.select("n", "ws", F.posexplode("ws").alias("i", "src"))
            .select("n", "src", F.explode(F.expr("slice(ws, i + 2, size(ws))")).alias("dst"))
            .groupBy("src", "dst").agg(F.sum("n").alias("n_docs")))


def _word_array(words: DataFrame) -> Column:
    return words.agg(F.sort_array(F.collect_list("word"))).scalar()
