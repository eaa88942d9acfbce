"""Sentiment: naive Bayes as relations, scores and their distribution."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from revana.functions.scores import sentiment_score
from revana.operators.lookup import BROADCAST_ROWS, union_all, word_lookup
from revana.operators.tokens import word_rows
from revana.workspace import materialise


@dataclass
class NaiveBayes:
    """``words``: (word, n, log_odds). ``prior``: log odds of the classes."""

    words: DataFrame
    prior: float


def fit_naive_bayes(train: DataFrame, label: str = "label", tokens: str = "tokens",
                    smoothing: float = 1.0) -> NaiveBayes:
    """Two-class multinomial naive Bayes with additive smoothing; label 1 is the
    positive class, 0 the negative one, and null rows are left out.

    Counts are combined before the shuffle. The word table is written to the
    shared folder, since every scored document is joined to it.
    """
    train = train.filter(F.col(label).isin(0, 1))
    counts = (word_rows(train, label, tokens=tokens)
              .groupBy("word")
              .agg(F.count_if(F.col(label) == 1).alias("pos"),
                   F.count_if(F.col(label) == 0).alias("neg")))
    counts = materialise(counts, "naive-bayes-counts")
    docs = train.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    if not docs[0] or not docs[1]:
        raise ValueError("naive Bayes needs training documents of both classes")
    s = smoothing
    total = counts.agg(F.sum("pos"), F.sum("neg"), F.count(F.lit(1))).first()
    pos_all, neg_all = (total[0] or 0) + s * total[2], (total[1] or 0) + s * total[2]
    words = counts.select(
        "word", (F.col("pos") + F.col("neg")).alias("n"),
        (F.log((F.col("pos") + s) / F.lit(pos_all))
         - F.log((F.col("neg") + s) / F.lit(neg_all))).alias("log_odds"))
    prior = words.sparkSession.range(1).select(
        F.log(F.lit((docs[0] + s) / (docs[1] + s)))).first()[0]
    return NaiveBayes(words, prior)


def score_sentiment(df: DataFrame, model: NaiveBayes, keep: Sequence[str] = ("comment_id",),
                    tokens: str = "tokens", gamma: float = 0.5, blank: float = 0.8,
                    broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``keep`` columns (together they identify a row), the probability ``raw``
    of the positive class and the ``sentiment_score`` made from it.

    Tokens are looked up in place and summed per document before anything is
    shuffled. Words the model does not know are ignored; a document without any
    token scores ``blank``.
    """
    keep = list(keep)
    facts = word_rows(df, *keep, tokens=tokens)
    parts = word_lookup(facts, model.words, weight="n", limit=broadcast_rows)
    sums = union_all([p.groupBy(*keep).agg(F.sum("log_odds").alias("x")) for p in parts]
                     + [df.select(*keep, F.when(F.size(tokens) > 0, 0.0).alias("x"))])
    # exp() stays finite; the probability is 0 or 1 long before.
    logit = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("x") + F.lit(model.prior)))
    return (sums.groupBy(*keep).agg(F.sum("x").alias("x"))
            .withColumn("raw", F.when(F.col("x").isNotNull(), 1 / (1 + F.exp(-logit))))
            .withColumn("sentiment_score", sentiment_score(
                F.col("raw"), F.col("x").isNull(), gamma, blank))
            .drop("x"))


def sentiment_distribution(df: DataFrame, col: str = "sentiment_score", neg: float = 0.05,
                           neu: tuple[float, float] = (0.4, 0.6), pos: float = 0.6) -> DataFrame:
    """Reviews per bucket and their percentage of the bucketed ones. Scores from
    ``neg`` up to the lower neutral bound are in no bucket."""
    s = F.col(col)
    counts = df.agg(F.count_if(s > pos).alias("positive"),
                    F.count_if((s >= neu[0]) & (s <= neu[1])).alias("neutral"),
                    F.count_if(s < neg).alias("negative"))
    rows = counts.select(F.inline(F.array(*[
        F.struct(F.lit(b).alias("bucket"), F.col(b).alias("n"),
                 (F.col("positive") + F.col("neutral") + F.col("negative")).alias("_all"))
        for b in ("positive", "neutral", "negative")])))
    return rows.select("bucket", "n", F.round(
        F.try_divide(100 * F.col("n"), F.col("_all")), 2).alias("percent"))


def in_bucket(df: DataFrame, bucket: str, col: str = "sentiment_score", neg: float = 0.05,
              neu: tuple[float, float] = (0.4, 0.6), pos: float = 0.6) -> DataFrame:
    """The reviews of one bucket of the distribution."""
    s = F.col(col)
    tests = {"positive": s > pos, "neutral": s.between(*neu), "negative": s < neg}
    return df.filter(tests[bucket])
