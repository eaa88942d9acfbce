"""Labelled documents as a survey: numbers, texts and a yes/no target."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from revana.catalog.base import documents, query, r6, sql, table
from revana.functions.text import letter_tokens
from revana.operators import attribution, features, survey, tuning
from revana.sources.tables import write_records
from revana.workspace import materialise, run_dir

TARGET = "willing"


def survey_table(spark, sf):
    """doc_id, n_chars, n_words, lang, source and the target as text."""
    answer = F.when(F.col("quality") == 1, survey.WILLING).otherwise("B")
    return (documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
            .select("doc_id", "n_chars", F.size(letter_tokens(F.col("text"))).alias("n_words"),
                    "lang", "source", answer.alias(TARGET)))


def labelled(spark, sf):
    return survey.binary_target(survey_table(spark, sf), TARGET)


def split(spark, sf):
    return survey.split_exact(labelled(spark, sf), "doc_id")


def stored_split(spark, sf):
    """For fitting, which reads the rows several times."""
    return materialise(split(spark, sf), "survey")


_SURVEY = r"""survey AS (SELECT doc_id, n_chars,
    len(regexp_extract_all(lower(text), '\p{L}+')) AS n_words, lang, source,
    CASE WHEN quality = 1 THEN 1 ELSE 0 END AS willing
  FROM documents JOIN labels USING (doc_id))"""
_SPLIT = """split AS (SELECT *, row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id)
    <= ceil(0.2 * count(*) OVER ()) AS is_test FROM survey)"""
_TRAIN = "train AS (SELECT * FROM split WHERE NOT is_test)"


@query("""SELECT doc_id, lang, source, n_chars FROM documents""")
def null_columns_dropped(spark, sf):
    """A column without any value goes; one with some nulls would stay."""
    docs = table(spark, sf, "documents").select(
        "doc_id", "lang", "source", "n_chars", F.nullif(F.col("lang"), F.col("lang")).alias("empty"))
    return survey.drop_all_null(docs)


@query("""SELECT doc_id, lang, source FROM documents""")
def columns_dropped(spark, sf):
    return survey.drop_columns(table(spark, sf, "documents"),
                               ["text", "n_chars", *survey.METADATA])


@query("""SELECT doc_id, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS quality
FROM documents LEFT JOIN labels USING (doc_id)""")
def binary_targets(spark, sf):
    """Null counts as 0."""
    df = (table(spark, sf, "documents").select("doc_id")
          .join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "quality"))
    return survey.binary_target(df.withColumn("quality", F.col("quality").cast("string")),
                                "quality", "1")


@query(sql(_SURVEY, """SELECT 'feature' AS part, c AS name, n FROM (
  SELECT count(n_chars) AS n_chars, count(n_words) AS n_words, count(lang) AS lang, count(source) AS source,
         count(doc_id) AS doc_id FROM survey) UNPIVOT (n FOR c IN (doc_id, n_chars, n_words, lang, source))
UNION ALL SELECT 'target', 'willing', count(willing) FROM survey"""))
def features_and_target(spark, sf):
    x, y = survey.features_and_target(labelled(spark, sf), TARGET)
    return (survey.column_profile(x).select(F.lit("feature").alias("part"), F.col("column").alias("name"),
                                            F.col("non_null").alias("n"))
            .unionByName(survey.column_profile(y).select(
                F.lit("target").alias("part"), F.col("column").alias("name"),
                F.col("non_null").alias("n"))))


@query("""SELECT kind, column_name, n FROM (
  SELECT 'numeric' AS kind, 'event_id' AS column_name, count(event_id) AS n FROM events UNION ALL
  SELECT 'numeric', 'user_id', count(user_id) FROM events UNION ALL
  SELECT 'numeric', 'value', count(value) FROM events UNION ALL
  SELECT 'text', 'event_type', count(event_type) FROM events UNION ALL
  SELECT 'text', 'props', count(props) FROM events)""")
def columns_by_type(spark, sf):
    """Time stamps are in neither list."""
    events = table(spark, sf, "events")
    numeric, text = survey.columns_by_type(events)
    kind = F.when(F.col("column").isin(numeric), "numeric").when(F.col("column").isin(text), "text")
    return (survey.column_profile(events).select(kind.alias("kind"), F.col("column").alias("column_name"),
                                                 F.col("non_null").alias("n"))
            .filter("kind is not null"))


@query("""SELECT 'doc_id' AS "column", 'bigint' AS type, count(doc_id) AS non_null FROM j UNION ALL
SELECT 'quality', 'int', count(quality) FROM j UNION ALL SELECT 'toxic', 'int', count(toxic) FROM j UNION ALL
SELECT 'lang', 'string', count(lang) FROM j""".replace(
    "FROM j", "FROM (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) j"))
def column_profile(spark, sf):
    return survey.column_profile(
        table(spark, sf, "documents").select("doc_id", "lang")
        .join(table(spark, sf, "labels"), "doc_id", "left")
        .select("doc_id", "quality", "toxic", "lang"))


@query(sql(_SURVEY, "SELECT doc_id, n_chars, CAST(n_words AS INTEGER) AS n_words, lang, source, willing "
           "FROM survey ORDER BY doc_id LIMIT 5"))
def survey_preview(spark, sf):
    """The first rows by id."""
    return survey.preview(labelled(spark, sf), order="doc_id")


@query(sql(_SURVEY, _SPLIT, "SELECT doc_id, is_test FROM split"))
def exact_split(spark, sf):
    return split(spark, sf).select("doc_id", "is_test")


@query(sql(_SURVEY, _SPLIT, """SELECT doc_id, n_chars, CAST(n_words AS INTEGER) AS n_words, lang, source FROM split
WHERE is_test ORDER BY md5(concat('42:', doc_id)), doc_id LIMIT 10"""))
def explained_rows(spark, sf):
    """The sample that is explained: the first ten test rows."""
    return (survey.first_rows(split(spark, sf).filter("is_test"), 10, "doc_id")
            .select("doc_id", "n_chars", "n_words", "lang", "source"))


@query(sql(_SURVEY, """SELECT doc_id, willing, CAST((row_number() OVER (PARTITION BY willing
  ORDER BY md5(concat('42:', doc_id)), doc_id) - 1) % 5 AS INTEGER) AS fold FROM survey"""))
def stratified_folds(spark, sf):
    return (survey.stratified_folds(labelled(spark, sf), TARGET, "doc_id")
            .select("doc_id", TARGET, "fold"))


@query(sql(_SURVEY, _SPLIT, _TRAIN, """stats AS (SELECT median(n_chars) AS mc, median(n_words) AS mw,
  avg(n_chars) AS ac, avg(n_words) AS aw, stddev_pop(n_chars) AS sc, stddev_pop(n_words) AS sw FROM train)""",
           """SELECT doc_id, round((n_chars - ac) / sc, 6) AS n_chars, round((n_words - aw) / sw, 6) AS n_words,
  round(mc, 6) AS median_chars, round(mw, 6) AS median_words FROM split, stats"""))
def scaled_numbers(spark, sf):
    """Fitted on the training rows, applied to all."""
    df = stored_split(spark, sf)
    model = features.MedianScaler(inputCols=["n_chars", "n_words"]).fit(df.filter("not is_test"))
    median = {c: m for c, m, *_ in model.columns}
    return model.transform(df).select(
        "doc_id", r6("n_chars").alias("n_chars"), r6("n_words").alias("n_words"),
        F.lit(round(median["n_chars"], 6)).alias("median_chars"),
        F.lit(round(median["n_words"], 6)).alias("median_words"))


@query(sql(_SURVEY, _SPLIT, _TRAIN, """SELECT doc_id, feature FROM (
  SELECT doc_id, 'lang_' || lang AS feature FROM split WHERE lang IN (SELECT lang FROM train)
  UNION ALL SELECT doc_id, 'source_' || source FROM split WHERE source IN (SELECT source FROM train))"""))
def one_hot_ones(spark, sf):
    """The ones of the fitted encoder, named from the vector's own metadata."""

    df = stored_split(spark, sf)
    model, _ = features.fit_features(
        df.filter("not is_test").select("doc_id", "lang", "source"), exclude=("doc_id",))
    coded = model.transform(features.prepare_text(df, ["lang", "source"]))
    names = F.array(*[F.lit(n) for n in features.feature_names(coded)])
    return (coded.select("doc_id", F.posexplode(vector_to_array("features")).alias("i", "v"))
            .filter("v = 1").select("doc_id", F.get(names, F.col("i")).alias("feature")))


@query(sql(_SURVEY, """SELECT doc_id, 'lang_' || lang AS feature FROM survey
UNION ALL SELECT doc_id, 'source_' || source FROM survey"""))
def one_hot_rows(spark, sf):
    return features.one_hot_long(survey_table(spark, sf), ["lang", "source"], "doc_id")


@query(sql(_SURVEY, _SPLIT, _TRAIN, """names AS (
  SELECT 'n_chars' AS feature, 0 AS g UNION ALL SELECT 'n_words', 1
  UNION ALL SELECT DISTINCT 'lang_' || lang, 2 FROM train
  UNION ALL SELECT DISTINCT 'source_' || source, 3 FROM train)""",
           "SELECT CAST(row_number() OVER (ORDER BY g, feature) - 1 AS INTEGER) AS idx, feature FROM names"))
def feature_names(spark, sf):
    train = stored_split(spark, sf).filter("not is_test").drop("is_test")
    _, ready = features.fit_features(train, exclude=("doc_id", TARGET))
    return spark.createDataFrame(list(enumerate(features.feature_names(ready))),
                                 "idx int, feature string")


@query(sql(_SURVEY, """cells AS (SELECT lang AS cell, source AS fold, avg(willing) AS accuracy
  FROM survey GROUP BY lang, source)""",
           """SELECT cell, round(avg(accuracy), 6) AS mean_accuracy FROM cells GROUP BY cell
ORDER BY avg(accuracy) DESC, cell LIMIT 1"""))
def best_cell(spark, sf):
    """Accuracies of always answering yes: languages as cells, sources as folds."""
    cells = (labelled(spark, sf).groupBy(F.col("lang").alias("cell"), F.col("source").alias("fold"))
             .agg(F.avg(TARGET).alias("accuracy")))
    return tuning.best_cell(cells).withColumn("mean_accuracy", r6("mean_accuracy"))


_PHI = """phi AS (SELECT doc_id, 'n_chars' AS feature, n_chars - avg(n_chars) OVER () AS phi FROM survey
  UNION ALL SELECT doc_id, 'n_words', 3 * (n_words - avg(n_words) OVER ()) FROM survey)"""
_SUMMARY = """SELECT feature, round(avg(phi), 3) + 0.0 AS mean_raw, round(avg(abs(phi)), 6) AS mean_abs
FROM phi GROUP BY feature"""


def _linear_phi(spark, sf):
    """Shapley values of a linear score, which are known in closed form."""
    df = survey_table(spark, sf)
    means = df.agg(F.struct(F.avg("n_chars").alias("c"), F.avg("n_words").alias("w"))).scalar()
    return df.withColumn("m", means).select("doc_id", F.inline(F.array(
        F.struct(F.lit("n_chars").alias("feature"), (F.col("n_chars") - F.col("m.c")).alias("phi")),
        F.struct(F.lit("n_words").alias("feature"),
                 (3 * (F.col("n_words") - F.col("m.w"))).alias("phi")))))


@query(sql(_SURVEY, _PHI, _SUMMARY))
def attribution_summary(spark, sf):
    summary = attribution.by_importance(attribution.attribution_summary(_linear_phi(spark, sf)))
    return summary.select("feature", (F.round("mean_raw", 3) + F.lit(0.0)).alias("mean_raw"),
                          r6("mean_abs").alias("mean_abs"))


@query(sql(_SURVEY, _PHI, _SUMMARY))
def attribution_records(spark, sf):
    """Written as JSON records and read back."""
    path = run_dir(spark, "attribution")
    write_records(attribution_summary(spark, sf), path)
    return spark.read.schema("feature string, mean_raw double, mean_abs double").json(path)
