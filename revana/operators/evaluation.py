"""Truth joins, confusion matrix, accuracy and classification report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from revana.functions.scores import LABELS, predicted_label, to_number, true_label


def join_truth(truth: DataFrame, scored: DataFrame, key: str = "comment_id") -> DataFrame:
    """Inner join of all (id, score) rows with the scored reviews. Of the two
    scores the left one counts; repeated ids multiply rows."""
    left = truth.select(key, F.col("score").alias("score_true"))
    right = scored.withColumnRenamed("score", "score_df")
    return left.join(right, key, "inner").withColumn("score", to_number(F.col("score_true")))


def label_pair_counts(truth: DataFrame, scored: DataFrame, key: str = "comment_id",
                      sentiment: str = "sentiment_score", pos: float = 0.2,
                      neg: float = 0.05) -> DataFrame:
    """Counts of (true_label, predicted_label) over ``join_truth``.

    Each side is first counted per id and label, at most three rows per id. An
    id repeated in both tables multiplies counts, not rows.
    """
    left = (truth.select(key, true_label(to_number(F.col("score"))).alias("true_label"))
            .groupBy(key, "true_label").agg(F.count(F.lit(1)).alias("n_true")))
    right = (scored.select(key, predicted_label(F.col(sentiment), pos, neg)
                           .alias("predicted_label"))
             .groupBy(key, "predicted_label").agg(F.count(F.lit(1)).alias("n_pred")))
    return (left.join(right, key).groupBy("true_label", "predicted_label")
            .agg(F.sum(F.col("n_true") * F.col("n_pred")).alias("n")))


def _weight(df: DataFrame, n: str | None):
    return F.lit(1).cast("long") if n is None else F.col(n)


def confusion_matrix(df: DataFrame, labels: Sequence = LABELS, true: str = "true_label",
                     pred: str = "predicted_label", n: str | None = None) -> DataFrame:
    """Long form of the matrix in label order, empty cells included.

    One aggregate counts all cells. ``n`` names a column of counts. The share of
    a row without any case is null.
    """
    cells = [(i, j) for i in range(len(labels)) for j in range(len(labels))]
    w = _weight(df, n)
    counted = df.agg(*[
        F.coalesce(F.sum(F.when((F.col(true) == labels[i]) & (F.col(pred) == labels[j]), w)),
                   F.lit(0)).alias(f"c{i}_{j}") for i, j in cells])
    rows = counted.select(F.inline(F.array(*[
        F.struct(F.lit(labels[i]).alias("true_label"), F.lit(labels[j]).alias("predicted_label"),
                 F.col(f"c{i}_{j}").alias("n")) for i, j in cells])))
    row_sum = F.sum("n").over(W.partitionBy("true_label"))
    return rows.withColumn("row_share", F.col("n") / F.nullif(row_sum, F.lit(0)))


def accuracy(df: DataFrame, true: str = "true_label", pred: str = "predicted_label",
             n: str | None = None) -> DataFrame:
    w = _weight(df, n)
    return df.agg((F.sum(F.when(F.col(true) == F.col(pred), w).otherwise(0)) / F.sum(w))
                  .alias("accuracy"))


def classification_report(df: DataFrame, true: str = "true_label", pred: str = "predicted_label",
                          n: str | None = None) -> DataFrame:
    """Precision, recall, f1 and support per label, then the accuracy row (its
    value in all four columns), macro and weighted averages.

    The rows are counted per label pair first. All else works on that table of
    label-count size.
    """
    pairs = (df.groupBy(F.col(true).cast("string").alias("t"), F.col(pred).cast("string").alias("p"))
             .agg(F.sum(_weight(df, n)).alias("n")))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)

    def side(label, as_true, as_pred, tp):
        return F.struct(label.alias("label"), as_true.cast("double").alias("support"),
                        as_pred.cast("double").alias("predicted"), tp.cast("double").alias("tp"))

    zero = F.lit(0)
    per_label = (pairs.select(F.inline(F.array(side(F.col("t"), F.col("n"), zero, hit),
                                               side(F.col("p"), zero, F.col("n"), zero))))
                 .groupBy("label")
                 .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
                 .withColumn("precision", _ratio("tp", "predicted"))
                 .withColumn("recall", _ratio("tp", "support"))
                 .withColumn("f1", F.coalesce(F.try_divide(
                     2 * F.col("precision") * F.col("recall"),
                     F.col("precision") + F.col("recall")), F.lit(0.0))))
    values = ["precision", "recall", "f1"]
    total = F.sum("support")

    def row(label, p, r, f, s):
        return F.struct(label.alias("label"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), s.alias("support"))

    def averages(label, mean):
        return row(F.lit(label), *[mean(F.col(v)) for v in values], total)

    acc = F.sum("tp") / total
    # As many rows as labels, so they fit one array next to their averages.
    whole = per_label.agg(
        F.collect_list(row(F.col("label"), *[F.col(v) for v in values], F.col("support")))
        .alias("labels"),
        F.array(row(F.lit("accuracy"), acc, acc, acc, acc),
                averages("macro avg", F.avg),
                averages("weighted avg", lambda v: F.sum(v * F.col("support")) / total))
        .alias("summary"))
    return whole.select(F.inline(F.concat("labels", "summary")))


def _ratio(top: str, bottom: str):
    return F.coalesce(F.try_divide(F.col(top), F.col(bottom)), F.lit(0.0))
