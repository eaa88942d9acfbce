"""Fitted models. Their numbers have no SQL equivalent; rows and invariants are
tested instead."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from revana.catalog.base import (BASE, REVIEWS, STOPS, WORDS, all_reviews, query, r6, scored_reviews, sql,
                                 tokens)
from revana.catalog.survey import _SPLIT, _SURVEY, _TRAIN, TARGET, stored_split
from revana.catalog.topics import KEYWORDS, NEGATIVE, POSITIVE
from revana.functions.scores import BAD, GOOD, comment_class
from revana.functions.wordlists import DEFAULT
from revana.operators import attribution, evaluation, features, lda, survey, topics, tuning
from revana.operators.lookup import union_all
from revana.operators.tokens import tokenize
from revana.sources.stopwords import as_stopwords
from revana.workspace import materialise, pack, scope


def _lda_corpora(spark, sf):
    with scope(spark):
        docs = materialise(tokens(scored_reviews(spark, sf), stop=True)
                           .select("doc_id", "score", "tokens"), "tokens")
        corpora = lda.build_corpora({POSITIVE: docs.filter("score = 5"), NEGATIVE: docs.filter("score < 3")})
    return {POSITIVE: (corpora[POSITIVE], 5), NEGATIVE: (corpora[NEGATIVE], 3)}


@query()
def lda_topics(spark, sf):
    """Five topics of the best reviews, three of the bad ones, exclusive words."""
    models = lda.fit_models(_lda_corpora(spark, sf))
    return topics.format_topics(topics.exclusive_terms(union_all([m.terms(cls) for cls, m in models.items()])))


_LDA_CLASSES = f"""classes(cls, k, keep) AS (VALUES ('{POSITIVE}', 5, 'best'), ('{NEGATIVE}', 3, 'bad'))"""
_LDA_WORDS = """lda_words AS (
  SELECT CASE WHEN score = 5 THEN 'best' ELSE 'bad' END AS keep, doc_id, word FROM words
  WHERE (score = 5 OR score < 3) AND word NOT IN (SELECT word FROM stops))"""


@query(sql(*BASE, STOPS, WORDS, _LDA_CLASSES, _LDA_WORDS, """SELECT cls, CAST(k AS INTEGER) AS topics, count(DISTINCT word) AS n_words, count(*) AS n_tokens,
  CAST(least(50, count(DISTINCT word)) AS BIGINT) AS listed_words, CAST(0 AS BIGINT) AS shared_words,
  CAST(k AS DOUBLE) AS weight_sum, CAST(count(*) + count(DISTINCT word) AS DOUBLE) AS mass
FROM classes JOIN lda_words USING (keep) GROUP BY cls, k"""))
def lda_totals(spark, sf):
    """What the topics of ``lda_topics`` must add up to: words and tokens of each
    class, words listed per topic, words in more than one exclusive list, weights, and the
    topics' mass, which is every token once and the prior of every word."""
    corpora = _lda_corpora(spark, sf)
    rows = []
    for cls, model in lda.fit_models(corpora).items():
        listed = materialise(model.terms(cls), "terms")
        exclusive = topics.exclusive_terms(listed)
        shared = exclusive.groupBy("word").count().filter("count > 1").count()
        per = listed.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"), F.max("n"), F.count(F.lit(1))).first()
        sums = model.weights.select(F.posexplode("w").alias("j", "x")).groupBy("j").agg(F.sum("x").alias("x")).collect()
        shares = sum(r.x / model.totals[r.j] for r in sums)
        rows.append((cls, per[2], corpora[cls][0].n_words, corpora[cls][0].n_tokens, per[0] if per[0] == per[1] else -1, shared,
                     round(shares, 6), round(sum(r.x for r in sums), 3)))
    return spark.createDataFrame(rows, "cls string, topics int, n_words long, n_tokens long, listed_words long, "
                                       "shared_words long, weight_sum double, mass double")


def _classes(spark, sf):
    """Raw tokens of all good and bad comments, case kept, nothing removed, as corpora."""
    docs = tokenize(all_reviews(spark, sf), mode="raw", lower=False).select(
        "doc_id", "tokens", comment_class(F.col("score")).alias("comment_type"))
    with scope(spark):
        docs = materialise(docs, "raw-tokens")
        return lda.build_corpora({KEYWORDS[POSITIVE]: docs.filter(F.col("comment_type") == GOOD),
                                  KEYWORDS[NEGATIVE]: docs.filter(F.col("comment_type") == BAD)})


@query()
def lda_keywords(spark, sf):
    """Seven topics of the good comments, five of the bad ones, ten passes; stop
    words leave the lists only."""
    corpora = _classes(spark, sf)
    models = lda.fit_models({cls: (corpus, k) for (cls, corpus), k in zip(corpora.items(), (7, 5))}, passes=10)
    return topics.topic_keywords(union_all([m.terms(cls) for cls, m in models.items()]), as_stopwords(spark, DEFAULT))


@query()
def lda_sweep(spark, sf):
    """Likelihood bound for 2 to 10 topics per class."""
    corpora = _classes(spark, sf)
    table = lda.sweep_topics(corpora)
    for corpus in corpora.values():
        corpus.release()
    return table


@query(sql(REVIEWS, rf"""raw AS (SELECT CASE WHEN coalesce(score_raw, 0) >= 4 THEN '{KEYWORDS[POSITIVE]}' ELSE '{KEYWORDS[NEGATIVE]}' END AS cls,
  len(regexp_extract_all(content, '\p{{L}}+|[^\p{{L}}]')) AS n FROM reviews WHERE coalesce(score_raw, 0) <> 3)""",
           """SELECT cls, CAST(k AS INTEGER) AS k, CAST(sum(n) AS BIGINT) AS n_tokens, true AS bound_is_negative
FROM raw, (SELECT unnest(range(2, 11)) AS k) GROUP BY cls, k"""))
def lda_sweep_cells(spark, sf):
    """The cells of the sweep, their tokens and the sign of the bound."""
    return lda_sweep(spark, sf).select("cls", "k", "n_tokens", (F.col("per_word_bound") < 0).alias("bound_is_negative"))


def _prepared(spark, sf):
    """Training and test rows ready for the feature stages."""
    rows = stored_split(spark, sf)
    train = rows.filter("not is_test").drop("is_test")
    built, ready = features.build_features(train, exclude=("doc_id", TARGET))
    test = features.prepare_text(rows.filter("is_test").drop("is_test"), ["lang", "source"])
    return built, materialise(ready, "train"), test


def _network(spark, sf, hidden=tuning.HIDDEN[0]):
    built, train, test = _prepared(spark, sf)
    stages = built.stages + [tuning.mlp(built.width, hidden, TARGET)]
    return Pipeline(stages=stages).fit(pack(train)), test


@query()
def network_report(spark, sf):
    """Classification report of the (50, 25) network on the test rows."""
    model, test = _network(spark, sf)
    report = evaluation.classification_report(model.transform(test)
                                              .withColumn("prediction", F.col("prediction").cast("int")),
                                              true=TARGET, pred="prediction")
    return report.select("label", *[r6(c).alias(c)
                                    for c in ("precision", "recall", "f1", "support")])


@query()
def network_parameters(spark, sf):
    model, _ = _network(spark, sf)
    return tuning.layer_sheets(tuning.layer_params(spark, tuning.final_network(model)))


@query(sql(_SURVEY, _SPLIT, _TRAIN, """widths AS (
  SELECT 2 + count(DISTINCT lang) + count(DISTINCT source) AS w FROM train)""",
           """SELECT 1 AS layer, 'weight' AS kind, 50 * w AS n FROM widths
UNION ALL SELECT 1, 'bias', 50 UNION ALL SELECT 2, 'weight', 50 * 25 UNION ALL SELECT 2, 'bias', 25
UNION ALL SELECT 3, 'weight', 25 * 2 UNION ALL SELECT 3, 'bias', 2"""))
def network_shape(spark, sf):
    """Number of exported parameters of each layer."""
    return network_parameters(spark, sf).groupBy("layer", "kind").agg(F.count("value").alias("n"))


@query(sql(_SURVEY, _SPLIT, """SELECT CAST(willing AS VARCHAR) AS label, CAST(count(*) AS DOUBLE) AS support
FROM split WHERE is_test GROUP BY willing"""))
def network_support(spark, sf):
    """Test rows of each label in the network's report."""
    return network_report(spark, sf).filter("label IN ('0', '1')").select("label", "support")


@query()
def grid_search(spark, sf):
    """Mean accuracy of all nine cells over five stratified folds."""
    built, train, _ = _prepared(spark, sf)
    folded = materialise(survey.stratified_folds(train, TARGET, "doc_id"), "folds")
    return tuning.tuning_table(spark, tuning.tune(folded, built, TARGET))


@query(sql(_SURVEY, _SPLIT, _TRAIN, """cells(cell, hidden, penalty) AS (VALUES (0, '50-25', 1e-4), (1, '50-25', 1e-3), (2, '50-25', 1e-2),
  (3, '100-50', 1e-4), (4, '100-50', 1e-3), (5, '100-50', 1e-2), (6, '50-50-25', 1e-4), (7, '50-50-25', 1e-3), (8, '50-50-25', 1e-2))""",
           """SELECT CAST(cell AS INTEGER) AS cell, hidden, CAST(penalty AS DOUBLE) AS penalty,
  (SELECT count(*) FROM train) AS n_scored FROM cells"""))
def grid_cells(spark, sf):
    """The cells of the search and the rows each is scored on, every training row once."""
    return grid_search(spark, sf).select("cell", "hidden", "penalty", "n_scored")


@query()
def shapley_summary(spark, sf):
    """First ten test rows explained against the first hundred."""
    model, test = _network(spark, sf)
    ready = PipelineModel(model.stages[:-1]).transform(test)
    names = features.feature_names(ready)
    ready = materialise(ready.select("doc_id", "features"), "features")
    phi = attribution.shapley_values(
        model.stages[-1], survey.first_rows(ready, 10, "doc_id"),
        survey.first_rows(ready, 100, "doc_id"), names)
    return attribution.by_importance(attribution.attribution_summary(phi))
