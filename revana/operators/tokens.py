"""Token columns, stop words, document-term counts and the vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from revana.functions import text as T
from revana.operators.lexicon import lexicon_tokens
from revana.operators.lookup import union_all, word_lookup
from revana.operators.ranking import hash_rank, prefix_digits
from revana.workspace import materialise

INLINE_STOPWORDS = 10_000


def tokenize(df: DataFrame, col: str = "content", mode: str = "letters", *, out: str = "tokens",
             lower: bool = True, n: int = 2, char_class: str = T.HAN,
             lexicon: DataFrame | None = None, id_col: str = "doc_id",
             custom: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add an array column of tokens.

    ``letters``: runs of letters. ``raw``: those and every other character.
    ``ngram``: overlapping n-grams of a script. ``blanks``: white-space
    separated. ``lexicon``: greedy longest match against a word table.
    ``custom``: your own column function, such as a pandas UDF.
    """
    text = F.col(col)
    if mode == "lexicon":
        return lexicon_tokens(df, lexicon, col=col, id_col=id_col, out=out)
    if custom is not None:
        return df.withColumn(out, custom(text))
    if mode == "letters":
        return df.withColumn(out, T.letter_tokens(text, lower))
    if mode == "raw":
        return df.withColumn(out, T.raw_tokens(text, lower))
    if mode == "ngram":
        return df.withColumn(out, T.ngram_tokens(text, n, char_class))
    if mode == "blanks":
        return df.withColumn(out, T.split_blanks(F.coalesce(text, F.lit(""))))
    raise ValueError(f"unknown tokenizer mode {mode!r}")


def word_rows(df: DataFrame, *keep: str | Column, tokens: str | Column = "tokens") -> DataFrame:
    """One row (``keep``, word) per token.

    For a plain explode the optimizer adds a filter on non-empty arrays and
    pushes it to the scan, where it tokenises every text a second time. The
    outer form gives no such filter.
    """
    return (df.select(*keep, F.explode_outer(tokens).alias("word"))
            .filter(F.col("word").isNotNull()))


def remove_stopwords(df: DataFrame, stop: DataFrame | Iterable[str], tokens: str = "tokens",
                     id_col: str = "doc_id") -> DataFrame:
    """Drop stop words from the token arrays; order and repeats are kept.

    A list of up to ``INLINE_STOPWORDS`` words becomes a hash-set test inside
    the array filter. A longer one is an anti-join on token rows, after which
    each document is put together again; documents are told apart by id and
    tokens. Either way null tokens go, a null array stays null, and no row merges.
    """
    if isinstance(stop, DataFrame):
        words = [r[0] for r in stop.select("word").limit(INLINE_STOPWORDS + 1).collect()]
    else:
        words = list(stop)
        if len(words) > INLINE_STOPWORDS:
            stop = df.sparkSession.createDataFrame([(w,) for w in words], "word string")
    if len(words) <= INLINE_STOPWORDS:
        words = [w for w in words if w is not None]
        return df.withColumn(tokens, F.filter(tokens, lambda w: w.isNotNull() & ~w.isin(words)))
    marked = df.withColumn("_id", F.xxhash64(id_col, F.lit(1), tokens)).withColumn("_id2", F.xxhash64(F.lit(2), id_col, tokens))
    keys = ["_id", "_id2"]
    kept = (marked.select(*keys, tokens).dropDuplicates(keys)
            .select(*keys, F.posexplode_outer(tokens).alias("_pos", "word"))
            .filter(F.col("word").isNotNull())
            .join(stop.select("word").distinct(), "word", "left_anti")
            .groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("_pos", "word"))).alias("_kept")))
    empty = F.when(F.col(tokens).isNotNull(), F.array().cast("array<string>"))
    return (marked.join(kept, keys, "left")
            .withColumn(tokens, F.coalesce(F.col("_kept.word"), empty))
            .drop("_kept", *keys))


def drop_stop_rows(rows: DataFrame, stop: DataFrame, word: str = "word") -> DataFrame:
    """Row form of the stop word filter."""
    stop = stop.select(F.col("word").alias(word)).distinct()
    return rows.join(stop, word, "left_anti")


def distinct_words(df: DataFrame, tokens: str = "tokens", id_col: str = "doc_id") -> DataFrame:
    """Set of words of each document, as rows."""
    return word_rows(df, id_col, tokens=F.array_distinct(tokens))


def doc_terms(df: DataFrame, tokens: str = "tokens", id_col: str = "doc_id", tasks: int | None = None) -> DataFrame:
    """Bag of words: count of each word in each document.

    The token arrays are hashed by document first, to ``tasks`` tasks if given. They are about half the size
    of the counted rows, and whatever groups by document afterwards, or by
    document and word, needs no further shuffle.
    """
    return (word_rows(df.select(id_col, tokens).repartition(*([tasks] if tasks else []), id_col), id_col, tokens=tokens)
            .groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("n")))


def vocabulary(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Every distinct word with a dense id from 0 and its corpus count.

    Nothing is pruned. Ids follow the hash of the word, so numbering them needs
    no sort of the whole vocabulary in one task. The counts are written before
    they are numbered, which reads them twice.
    """
    return number_words(word_rows(df, tokens=tokens).groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def number_words(counts: DataFrame) -> DataFrame:
    """(word_id, word, n) of word counts, as in ``vocabulary``."""
    words = materialise(counts, "words")
    return (hash_rank(words, F.md5("word"), "word", digits=prefix_digits(words.count()))
            .select((F.col("rank") - 1).alias("word_id"), "word", "n"))


def term_ids(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Replace the words of document-term counts by their ids. ``vocab`` should
    be a written table; words it does not hold are dropped."""
    facts = terms.withColumnRenamed("n", "n_doc")
    parts = word_lookup(facts, vocab, weight="n")
    return union_all([p.drop("word", "n").withColumnRenamed("n_doc", "n") for p in parts])
