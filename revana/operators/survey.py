"""Survey tables: column choice, target, split and folds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F, types as T

from revana.operators.ranking import hash_cutoff, hash_rank, seeded_hash

# Metadata columns of the survey export.
METADATA = ("答题序号", "来源", "开始时间", "提交时间", "答题时长",
            "IP省份", "IP城市", "IP地址", "浏览器", "操作系统")
WILLING = "A.愿意"

_NUMERIC = (T.IntegerType, T.LongType, T.DoubleType)


def _c(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def column_profile(df: DataFrame) -> DataFrame:
    """Rows (column, type, non_null), from one aggregate over all columns."""
    counted = df.agg(*[F.count(_c(f.name)).alias(f"n{i}") for i, f in enumerate(df.schema.fields)])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                 F.col(f"n{i}").alias("non_null")) for i, f in enumerate(df.schema.fields)])))


def preview(df: DataFrame, n: int = 5, order: str | None = None) -> DataFrame:
    """A few rows to look at, the first by ``order`` if given, else any. For
    value ranges use ``df.summary()``."""
    return (df.orderBy(_c(order)) if order else df).limit(n)


def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop the columns without any value."""
    empty = [r["column"] for r in column_profile(df).filter("non_null = 0").collect()]
    return df.select([_c(c) for c in df.columns if c not in empty])


def drop_columns(df: DataFrame, names: Iterable[str] = METADATA) -> DataFrame:
    """Drop columns; names the table does not have are ignored."""
    return df.drop(*names)


def binary_target(df: DataFrame, col: str, positive: str = WILLING) -> DataFrame:
    """1 where the column equals ``positive``, else 0; null is 0."""
    return df.withColumn(col, F.when(_c(col) == positive, 1).otherwise(0))


def features_and_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(_c(target))


def columns_by_type(df: DataFrame, exclude: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """Names of the numeric and of the text columns; other types are in neither."""
    fields = [f for f in df.schema.fields if f.name not in set(exclude)]
    return ([f.name for f in fields if isinstance(f.dataType, _NUMERIC)],
            [f.name for f in fields if isinstance(f.dataType, T.StringType)])


def split_exact(df: DataFrame, id_col: str, test_share: float = 0.2,
                seed: int = 42) -> DataFrame:
    """Add ``is_test``, true for exactly ceil(``test_share`` * n) rows.

    Test rows come first in the order of ``md5(seed:id)``. Where the order is
    cut is found on a sliver of the ids; the split itself is a filter.
    """
    h = seeded_hash(seed, id_col)
    cut = (hash_cutoff(df, h, id_col, test_share)
           .select(F.struct("h", "id").alias("cut")).scalar())
    return df.withColumn("is_test", F.struct(h.alias("h"), F.col(id_col).alias("id")) <= cut)


def split_order(df: DataFrame, id_col: str, seed: int = 42) -> list:
    """Sort keys that put rows in split order."""
    return [seeded_hash(seed, id_col), F.col(id_col)]


def first_rows(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """The first ``n`` rows in split order."""
    return df.orderBy(*split_order(df, id_col, seed)).limit(n)


def stratified_folds(df: DataFrame, target: str, id_col: str, k: int = 5,
                     seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold number 0..k-1; within each class the folds differ by at most one row."""
    ranked = hash_rank(df, seeded_hash(seed, id_col), id_col, by=(target,), out="_rank")
    return ranked.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")
