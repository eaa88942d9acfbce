"""The survey study: clean, split, tune, evaluate, export, explain."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from revana.operators import attribution, evaluation, features, survey, tuning
from revana.sources.tables import write_records, write_sheets, write_table
from revana.workspace import materialise


@dataclass
class SurveyStudy:
    """The tuned model, and the test rows ready for it."""

    search: tuning.Search
    model: PipelineModel
    test: DataFrame
    target: str
    id_col: str
    seed: int

    @property
    def spark(self) -> SparkSession:
        return self.test.sparkSession

    def candidates(self) -> DataFrame:
        return tuning.tuning_table(self.spark, self.search)

    def predictions(self) -> DataFrame:
        return (self.model.transform(self.test)
                .withColumn("prediction", F.col("prediction").cast("int")))

    def report(self) -> DataFrame:
        return evaluation.classification_report(self.predictions(), self.target, "prediction")

    def accuracy(self) -> DataFrame:
        return evaluation.accuracy(self.predictions(), self.target, "prediction")

    def parameters(self) -> DataFrame:
        """Layer parameters of the best network."""
        return tuning.layer_params(self.spark, tuning.final_network(self.model))

    def attribution(self, n_explained: int = 10, n_background: int = 100,
                    permutations: int = 2) -> DataFrame:
        ready = PipelineModel(self.model.stages[:-1]).transform(self.test)
        names = features.feature_names(ready)
        ready = materialise(ready.select(self.id_col, "features"), "features")
        phi = attribution.shapley_values(
            self.model.stages[-1],
            survey.first_rows(ready, n_explained, self.id_col, self.seed),
            survey.first_rows(ready, n_background, self.id_col, self.seed), names,
            permutations, self.seed, self.id_col, n_background)
        return attribution.by_importance(attribution.attribution_summary(phi))

    def write(self, folder: str) -> None:
        write_table(self.candidates(), f"{folder}/candidates")
        write_table(self.report(), f"{folder}/classification_report")
        summary = materialise(self.attribution(), "attribution")
        write_table(attribution.by_importance(summary), f"{folder}/attribution")
        write_records(attribution.by_importance(summary), f"{folder}/attribution_records")
        write_sheets(tuning.layer_sheets(self.parameters()), f"{folder}/parameters")


def survey_study(data: DataFrame, target: str, id_col: str, positive: str = survey.WILLING,
                 drop: Iterable[str] = survey.METADATA, test_share: float = 0.2, seed: int = 42,
                 num_folds: int = 5, **search) -> SurveyStudy:
    """From the raw survey table to a tuned model. ``id_col`` identifies a row;
    it orders the split and the folds and is no feature."""
    drop = [c for c in drop if c != id_col]
    data = survey.drop_columns(survey.drop_all_null(data), drop)
    data = survey.binary_target(data, target, positive)
    rows = materialise(survey.split_exact(data, id_col, test_share, seed), "survey")
    train = rows.filter("not is_test").drop("is_test")
    built, ready = features.build_features(train, exclude=(id_col, target))
    _, text = survey.columns_by_type(train, exclude=(id_col, target))
    folds = materialise(
        survey.stratified_folds(ready, target, id_col, num_folds, seed), "folds")
    found = tuning.tune(folds, built, target, num_folds=num_folds, seed=seed, **search)
    test = features.prepare_text(rows.filter("is_test").drop("is_test"), text)
    return SurveyStudy(found, found.bestModel, test, target, id_col, seed)
