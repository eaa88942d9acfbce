"""Sentiment scores and their evaluation against the true scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from revana.catalog.base import (BASE, REVIEWS, STOPS, TOKENS, query, r6, reviews, scored_reviews, sql, tokens)
from revana.functions.scores import predicted_label, true_label
from revana.functions.wordlists import DEFAULT
from revana.operators import evaluation, survey
from revana.operators.dedup import dedup_first
from revana.operators.sentiment import (fit_naive_bayes, in_bucket, score_sentiment,
                                        sentiment_distribution)
from revana.plans.collect import collect_comments
from revana.plans.reviews import review_study
from revana.sources.pages import as_pages
from revana.sources.tables import default_score, read_comments
from revana.workspace import materialise, run_dir


def scored(spark, sf):
    """Deduplicated reviews scored by a model of the labelled ones among them."""
    docs = materialise(tokens(scored_reviews(spark, sf), stop=True)
                       .select("comment_id", "doc_id", "score", "quality", "tokens"), "tokens")
    model = fit_naive_bayes(docs, "quality")
    return score_sentiment(docs, model, keep=["doc_id", "comment_id", "score"]).drop("doc_id")


def _truth(spark, sf):
    return default_score(reviews(spark, sf).select("comment_id", F.col("score_raw").alias("score")))


_NB = [*BASE, STOPS,
       """kept AS (SELECT comment_id, score, quality, word FROM (
  SELECT comment_id, score, quality, unnest(tokens) AS word FROM toks)
  WHERE word NOT IN (SELECT word FROM stops))""",
       """counts AS (SELECT word, count(*) FILTER (WHERE quality = 1) AS pos,
  count(*) FILTER (WHERE quality = 0) AS neg FROM kept WHERE quality IN (0, 1) GROUP BY word)""",
       "totals AS (SELECT sum(pos) AS tp, sum(neg) AS tn, count(*) AS v FROM counts)",
       """odds AS (SELECT word, ln((pos + 1) / (tp + v)) - ln((neg + 1) / (tn + v)) AS log_odds
  FROM counts, totals)""",
       """prior AS (SELECT ln((count(*) FILTER (WHERE quality = 1) + 1)
  / (count(*) FILTER (WHERE quality = 0) + 1)) AS p FROM dedup)""",
       """sums AS (SELECT comment_id, coalesce(sum(log_odds), 0) AS x
  FROM kept LEFT JOIN odds USING (word) GROUP BY comment_id)""",
       """scores AS (SELECT comment_id, score, CASE WHEN x IS NULL THEN NULL
    ELSE 1 / (1 + exp(-greatest(-700, least(700, x + p)))) END AS raw
  FROM dedup LEFT JOIN sums USING (comment_id), prior)""",
       """scored AS (SELECT comment_id, score, raw, CASE WHEN raw IS NULL THEN 0.8
    ELSE round(sqrt(raw) / (sqrt(raw) + sqrt(1 - raw)), 9) END AS s FROM scores)""",
       """labelled AS (SELECT r.comment_id, coalesce(r.score_raw, 0) AS score, s,
    CASE WHEN coalesce(r.score_raw, 0) >= 4 THEN 'positive'
         WHEN coalesce(r.score_raw, 0) <= 2 THEN 'negative' ELSE 'neutral' END AS true_label,
    CASE WHEN s > 0.2 THEN 'positive' WHEN s < 0.05 THEN 'negative' ELSE 'neutral' END AS predicted_label
  FROM reviews r JOIN scored USING (comment_id))"""]

# Collected comments: pages of 20 in seven files, every third id absent, the others
# each twice; a comment of which no score is known has none on its page.
_COLLECTED = [
    REVIEWS,
    """collected AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'jd' ELSE concat('jd', doc_id // 2) END AS comment_id,
    coalesce(content, '') AS content,
    CAST(coalesce(score_raw, 0) AS DOUBLE) AS score_raw,
    row_number() OVER (ORDER BY (doc_id // 20) % 7, doc_id // 20, doc_id DESC) - 1 AS seq FROM reviews)""",
    """dedup AS (SELECT * EXCLUDE (rn), score_raw AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY content ORDER BY seq) AS rn FROM collected) WHERE rn = 1)""",
    TOKENS, STOPS,
    """kept AS (SELECT seq, score, word FROM (SELECT seq, score, unnest(tokens) AS word FROM toks)
  WHERE word NOT IN (SELECT word FROM stops))""",
    """counts AS (SELECT word, count(*) FILTER (WHERE score >= 4) AS pos,
  count(*) FILTER (WHERE score < 3) AS neg FROM kept WHERE score >= 4 OR score < 3 GROUP BY word)""",
    "totals AS (SELECT sum(pos) AS tp, sum(neg) AS tn, count(*) AS v FROM counts)",
    "odds AS (SELECT word, ln((pos + 1) / (tp + v)) - ln((neg + 1) / (tn + v)) AS log_odds FROM counts, totals)",
    """prior AS (SELECT ln((count(*) FILTER (WHERE score >= 4) + 1) / (count(*) FILTER (WHERE score < 3) + 1)) AS p FROM dedup)""",
    "sums AS (SELECT seq, coalesce(sum(log_odds), 0) AS x FROM kept LEFT JOIN odds USING (word) GROUP BY seq)",
    """scores AS (SELECT comment_id, seq, CASE WHEN x IS NULL THEN NULL
    ELSE 1 / (1 + exp(-greatest(-700, least(700, x + p)))) END AS raw FROM dedup LEFT JOIN sums USING (seq), prior)""",
    """scored AS (SELECT comment_id, seq, CASE WHEN raw IS NULL THEN 0.8
    ELSE round(sqrt(raw) / (sqrt(raw) + sqrt(1 - raw)), 9) END AS s FROM scores)""",
    """labelled AS (SELECT CASE WHEN score_raw >= 4 THEN 'positive' WHEN score_raw <= 2 THEN 'negative' ELSE 'neutral' END AS true_label,
    CASE WHEN s > 0.2 THEN 'positive' WHEN s < 0.05 THEN 'negative' ELSE 'neutral' END AS predicted_label
  FROM collected JOIN scored USING (comment_id))"""]


def _collected(spark, sf):
    """Reviews written as pages, the latest of a page first, and collected."""
    inbox, store = run_dir(spark, "inbox"), run_dir(spark, "store")
    records = reviews(spark, sf).select(
        F.expr("doc_id div 20").alias("page"), F.when(F.col("doc_id") % 3 != 0, F.expr("doc_id div 2")).alias("id"),
        "content", F.lit("t").alias("creationTime"), F.col("score_raw").alias("score"), (-F.col("doc_id")).alias("by"))
    pages = as_pages(records, "page", order="by").withColumn("file", F.col("page") % 7)
    (pages.repartition("file").sortWithinPartitions("file", "page").select("file", "value")
     .write.partitionBy("file").text(inbox))
    collect_comments(spark, inbox, store, one_per_line=True)
    return read_comments(spark, store, seq="stored")


@query(sql(*_COLLECTED[:3], "SELECT comment_id, content, score, seq FROM dedup"))
def collected_reviews(spark, sf):
    """What first-wins deduplication by the ingest sequence keeps of collected pages."""
    return dedup_first(_collected(spark, sf), "content", "seq").select("comment_id", "content", "score", "seq")


_LABELS = "(SELECT unnest(['positive', 'neutral', 'negative']) AS {})"


@query(sql(*_NB, """SELECT comment_id, score, round(raw, 6) AS raw, round(s, 6) AS sentiment_score
FROM scored"""))
def sentiment_scores(spark, sf):
    return scored(spark, sf).select("comment_id", "score", r6("raw").alias("raw"),
                                    r6("sentiment_score").alias("sentiment_score"))


def _halves(spark, sf):
    """Tokens of the deduplicated reviews with the exact split."""
    docs = tokens(scored_reviews(spark, sf), stop=True)
    docs = docs.select("comment_id", "doc_id", "score", "quality", "tokens")
    return materialise(survey.split_exact(docs, "doc_id"), "split-tokens")


_HELD_OUT = [*BASE, STOPS,
             """split AS (SELECT *, row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id)
    <= ceil(0.2 * count(*) OVER ()) AS is_test FROM toks)""",
             """kept AS (SELECT comment_id, quality, is_test, word FROM (
  SELECT comment_id, quality, is_test, unnest(tokens) AS word FROM split)
  WHERE word NOT IN (SELECT word FROM stops))""",
             """counts AS (SELECT word, count(*) FILTER (WHERE quality = 1) AS pos,
  count(*) FILTER (WHERE quality = 0) AS neg FROM kept WHERE quality IN (0, 1) AND NOT is_test GROUP BY word)""",
             "totals AS (SELECT sum(pos) AS tp, sum(neg) AS tn, count(*) AS v FROM counts)",
             """odds AS (SELECT word, ln((pos + 1) / (tp + v)) - ln((neg + 1) / (tn + v)) AS log_odds
  FROM counts, totals)""",
             """prior AS (SELECT ln((count(*) FILTER (WHERE quality = 1) + 1)
  / (count(*) FILTER (WHERE quality = 0) + 1)) AS p FROM split WHERE NOT is_test)""",
             """sums AS (SELECT comment_id, coalesce(sum(log_odds), 0) AS x
  FROM kept LEFT JOIN odds USING (word) WHERE is_test GROUP BY comment_id)"""]


@query(sql(*_HELD_OUT, """SELECT quality, count(*) AS n, count(*) FILTER (WHERE (x + p > 0) = (quality = 1)) AS correct
FROM split JOIN sums USING (comment_id), prior WHERE is_test AND quality IN (0, 1) GROUP BY quality"""))
def sentiment_held_out(spark, sf):
    """Labelled test reviews with words, and how many fall on the side of their
    label, by a model that was fitted on the training reviews only."""
    docs = _halves(spark, sf)
    model = fit_naive_bayes(docs.filter("not is_test"), "quality")
    found = score_sentiment(docs.filter("is_test"), model, keep=["doc_id", "quality"])
    right = (F.col("raw") > 0.5) == (F.col("quality") == 1)
    return (found.filter("raw IS NOT NULL AND quality IN (0, 1)").groupBy("quality")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("correct")))


@query(sql(*_NB, """SELECT bucket, n, round(100.0 * n / sum(n) OVER (), 2) AS percent FROM (
  SELECT 'positive' AS bucket, count(*) FILTER (WHERE s > 0.6) AS n FROM scored UNION ALL
  SELECT 'neutral', count(*) FILTER (WHERE s BETWEEN 0.4 AND 0.6) FROM scored UNION ALL
  SELECT 'negative', count(*) FILTER (WHERE s < 0.05) FROM scored)"""))
def sentiment_buckets(spark, sf):
    return sentiment_distribution(scored(spark, sf))


@query(sql(*_NB, "SELECT comment_id, round(s, 6) AS sentiment_score FROM scored WHERE s < 0.05"))
def negative_reviews(spark, sf):
    return in_bucket(scored(spark, sf), "negative").select(
        "comment_id", r6("sentiment_score").alias("sentiment_score"))


@query(sql(*_NB[:2], """SELECT comment_id, CASE WHEN score >= 4 THEN 'positive'
  WHEN score <= 2 THEN 'negative' ELSE 'neutral' END AS true_label FROM dedup"""))
def true_labels(spark, sf):
    return scored_reviews(spark, sf).select(
        "comment_id", true_label(F.col("score")).alias("true_label"))


@query(sql(*_NB, """SELECT comment_id, CAST(score AS DOUBLE) AS score, true_label, predicted_label
FROM labelled"""))
def truth_join(spark, sf):
    joined = evaluation.join_truth(_truth(spark, sf), scored(spark, sf))
    return joined.select("comment_id", "score", true_label(F.col("score")).alias("true_label"),
                         predicted_label(F.col("sentiment_score")).alias("predicted_label"))


def _pairs(spark, sf):
    return evaluation.label_pair_counts(_truth(spark, sf), scored(spark, sf))


@query(sql(*_NB, f"""SELECT t.true_label, p.predicted_label, count(l.comment_id) AS n,
  round(count(l.comment_id) / nullif(sum(count(l.comment_id)) OVER (PARTITION BY t.true_label), 0), 6) AS row_share
FROM {_LABELS.format('true_label')} t CROSS JOIN {_LABELS.format('predicted_label')} p
LEFT JOIN labelled l ON l.true_label = t.true_label AND l.predicted_label = p.predicted_label
GROUP BY t.true_label, p.predicted_label"""))
def sentiment_confusion(spark, sf):
    matrix = evaluation.confusion_matrix(_pairs(spark, sf), n="n")
    return matrix.withColumn("row_share", r6("row_share"))


@query(sql(*_COLLECTED, f"""SELECT t.true_label, p.predicted_label, count(l.true_label) AS n,
  round(count(l.true_label) / nullif(sum(count(l.true_label)) OVER (PARTITION BY t.true_label), 0), 6) AS row_share
FROM {_LABELS.format('true_label')} t CROSS JOIN {_LABELS.format('predicted_label')} p
LEFT JOIN labelled l ON l.true_label = t.true_label AND l.predicted_label = p.predicted_label
GROUP BY t.true_label, p.predicted_label"""))
def collected_confusion(spark, sf):
    """From stored pages to the confusion matrix: collect, study in the order of
    collection, score with a model of the clearly good and bad comments."""
    comments = _collected(spark, sf)
    label = F.when(F.col("score") >= 4, 1).when(F.col("score") < 3, 0)
    study = review_study(comments.withColumn("label", label), DEFAULT, order="seq", keep=["label"])
    pairs = study.label_pairs(study.sentiment(fit_naive_bayes(study.tokens)))
    return evaluation.confusion_matrix(pairs, n="n").withColumn("row_share", r6("row_share"))


@query(sql(*_NB, """SELECT round(avg(CASE WHEN true_label = predicted_label THEN 1.0 ELSE 0 END), 6) AS accuracy
FROM labelled"""))
def sentiment_accuracy(spark, sf):
    return evaluation.accuracy(_pairs(spark, sf), n="n").select(r6("accuracy").alias("accuracy"))


@query(sql(*_NB, f"""per AS (SELECT label,
    (SELECT count(*) FROM labelled WHERE true_label = label AND predicted_label = label) AS tp,
    (SELECT count(*) FROM labelled WHERE true_label = label) AS support,
    (SELECT count(*) FROM labelled WHERE predicted_label = label) AS predicted
  FROM {_LABELS.format('label')})""",
           """pr AS (SELECT label, tp, support, coalesce(tp / nullif(predicted, 0), 0) AS p,
    coalesce(tp / nullif(support, 0), 0) AS r FROM per WHERE support + predicted > 0)""",
           "f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM pr)",
           """report AS (SELECT label, p, r, f1, support FROM f
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support),
    sum(tp) / sum(support), sum(tp) / sum(support) FROM f
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f1), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM f)""",
           """SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1,
  round(CAST(support AS DOUBLE), 6) AS support FROM report"""))
def sentiment_report(spark, sf):
    report = evaluation.classification_report(_pairs(spark, sf), n="n")
    return report.select("label", *[r6(c).alias(c)
                                    for c in ("precision", "recall", "f1", "support")])
