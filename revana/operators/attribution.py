"""Attribution of predictions to features by sampled Shapley values."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.base import Model
from pyspark.sql import DataFrame, functions as F

MAX_BACKGROUND = 10_000


def shapley_values(model: Model, explain: DataFrame, background: DataFrame, names: list[str],
                   permutations: int = 2, seed: int = 42, id_col: str = "doc_id",
                   background_rows: int = 100, class_index: int = 1) -> DataFrame:
    """Rows (id, feature, phi): how much each feature moves the probability of
    ``class_index`` from its mean over the background.

    For every explained row, background row and random feature order the model
    sees d + 1 vectors, in which one feature after the other is switched from
    the background to the explained value. Each prediction counts for the
    feature switched last and against the one switched next. Those sums
    telescope, so the phi of a row add up to f(row) - mean f(background), and
    they combine before the shuffle.

    Any number of rows may be explained. The background is a small sample by
    definition; its first ``background_rows`` rows in id order are used.
    """
    if background_rows > MAX_BACKGROUND:
        raise ValueError(f"at most {MAX_BACKGROUND} background rows, not {background_rows}")
    d = len(names)
    sample = (background.select(F.col(id_col).alias("bid"), vector_to_array("features").alias("b"))
              .orderBy("bid").limit(background_rows))
    base = sample.agg(F.sort_array(F.collect_list(F.struct("bid", "b")))).scalar()
    runs = (explain.select(id_col, vector_to_array("features").alias("x"),
                           F.explode(base).alias("bg"))
            .select(id_col, "x", "bg", F.explode(F.sequence(F.lit(1), F.lit(permutations)))
                    .alias("perm"))
            # One explained row is bg x permutations runs: spread those evenly.
            .repartition(id_col, "bg.bid", "perm"))
    index = F.sequence(F.lit(0), F.lit(d - 1))
    order = F.transform(F.array_sort(F.transform(index, lambda j: F.struct(
        F.xxhash64(F.lit(seed), F.col("perm"), F.col(id_col), F.col("bg.bid"), j).alias("h"),
        j.alias("j")))), lambda s: s["j"])
    place = F.transform(F.array_sort(F.transform(
        F.col("order"), lambda j, i: F.struct(j.alias("j"), i.alias("i")))), lambda s: s["i"])
    steps = (runs.withColumn("order", order).withColumn("place", place)
             .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(d))))
             .withColumn("features", array_to_vector(F.transform(index, lambda j: F.when(
                 F.get("place", j) < F.col("step"), F.get("x", j)).otherwise(
                 F.get("bg.b", j))))))
    p = vector_to_array("probability")[class_index]
    scored = model.transform(steps).select(id_col, "order", "step", p.alias("p"))
    signed = scored.select(id_col, F.explode(F.array(
        F.struct(F.get("order", F.col("step") - 1).alias("j"), F.col("p").alias("delta")),
        F.struct(F.get("order", F.col("step")).alias("j"), (-F.col("p")).alias("delta"))))
        .alias("s")).filter("s.j is not null")
    n_background = sample.agg(F.count(F.lit(1))).scalar()
    labels = F.array(*[F.lit(n) for n in names])
    return (signed.groupBy(id_col, "s.j").agg(F.sum("s.delta").alias("total"))
            .select(id_col, F.get(labels, F.col("j")).alias("feature"),
                    (F.col("total") / (n_background * permutations)).alias("phi")))


def attribution_summary(phi: DataFrame) -> DataFrame:
    """Mean and mean absolute attribution of each feature."""
    return phi.groupBy("feature").agg(F.avg("phi").alias("mean_raw"),
                                      F.avg(F.abs("phi")).alias("mean_abs"))


def by_importance(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc("mean_abs"), "feature")
