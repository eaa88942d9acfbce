"""The review study: one token table, and every report that hangs off it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from revana.functions.text import keep_script
from revana.operators import evaluation, lda, sentiment, terms, topics
from revana.operators.dedup import dedup_first
from revana.operators.lookup import union_all
from revana.operators.tokens import remove_stopwords, tokenize
from revana.sources.tables import default_score, write_records, write_table
from revana.sources.topics import write_topic_document
from revana.workspace import materialise

# Class keys, score filters and topic counts of the topic document.
TOPIC_CLASSES = (("positive_reviews_lda", "score = 5", 5), ("negative_reviews_lda", "score < 3", 3))


@dataclass
class ReviewStudy:
    """``reviews``: all (comment_id, score). ``tokens``: the deduplicated reviews
    (comment_id, score, order column, tokens), stop words removed."""

    reviews: DataFrame
    tokens: DataFrame
    order: str

    def counts(self) -> DataFrame:
        return terms.corpus_counts(self.tokens)

    def frequency(self) -> DataFrame:
        return terms.word_frequency(self.tokens)

    def top_words(self, k: int = 30) -> DataFrame:
        return terms.top_words(terms.meaningful(self.frequency()), k)

    def cloud(self, k: int = 1000) -> DataFrame:
        return terms.cloud_weights(terms.meaningful(self.frequency()), k)

    def nodes(self, k: int = 30) -> DataFrame:
        return terms.cooccurrence_nodes(terms.meaningful(self.frequency()), k)

    def edges(self, k: int = 30) -> DataFrame:
        return terms.cooccurrence_edges(self.tokens, terms.meaningful(self.frequency()), k)

    def sentiment(self, model: sentiment.NaiveBayes, gamma: float = 0.5) -> DataFrame:
        return sentiment.score_sentiment(self.tokens, model, list(dict.fromkeys([self.order, "comment_id", "score"])), gamma=gamma)

    def label_pairs(self, scored: DataFrame) -> DataFrame:
        return evaluation.label_pair_counts(self.reviews, scored)

    def topics(self, classes=TOPIC_CLASSES, seed: int = 42, passes: int = 1) -> DataFrame:
        """Topic texts per class, each word only in its best topic."""
        corpora = lda.build_corpora({cls: self.tokens.filter(keep) for cls, keep, _ in classes}, id_col=self.order)
        models = lda.fit_models({cls: (corpora[cls], k) for cls, _, k in classes}, seed, passes)
        return topics.format_topics(topics.exclusive_terms(union_all([m.terms(cls) for cls, m in models.items()])))

    def write(self, folder: str, model: sentiment.NaiveBayes, fmt: str = "csv") -> None:
        """Every report as a file of its own under ``folder``."""
        scored = materialise(self.sentiment(model), "sentiment")
        pairs = materialise(self.label_pairs(scored), "label-pairs")
        tables = {
            "word_frequency": terms.ordered(self.frequency()), "top_words": self.top_words(),
            "cloud": self.cloud(), "nodes": self.nodes(), "edges": self.edges(),
            "counts": self.counts(), "sentiment": scored,
            "sentiment_distribution": sentiment.sentiment_distribution(scored),
            "confusion_matrix": evaluation.confusion_matrix(pairs, n="n"),
            "accuracy": evaluation.accuracy(pairs, n="n"),
        }
        for name, df in tables.items():
            write_table(df, f"{folder}/{name}", fmt)
        write_records(evaluation.classification_report(pairs, n="n"), f"{folder}/report")
        write_topic_document(self.topics(), "topic_string", f"{folder}/topics")


def review_study(reviews: DataFrame, stop: DataFrame | Iterable[str] = (),
                 order: str = "doc_id", mode: str = "letters", script: str | None = None,
                 gap: str = "", keep: Iterable[str] = (), **tokenizer) -> ReviewStudy:
    """Deduplicate, clean, tokenise and drop stop words, once.

    ``script`` keeps only that character class before tokenising
    (``functions.text.HAN`` for Chinese, with ``mode="lexicon"`` or ``"ngram"``); ``gap`` replaces what it
    drops. The token table is written to the shared folder.
    """
    reviews = default_score(reviews)
    rows = dedup_first(reviews, "content", order)
    if script:
        rows = rows.withColumn("content", keep_script(F.col("content"), script, gap))
    rows = tokenize(rows, "content", mode, id_col=order, **tokenizer)
    rows = remove_stopwords(rows, stop, id_col=order)
    cols = list(dict.fromkeys(["comment_id", "score", order, *keep, "tokens"]))
    return ReviewStudy(reviews.select("comment_id", "score"),
                       materialise(rows.select(cols), "tokens"), order)
