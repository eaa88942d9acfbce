"""Where intermediate tables go, and how narrow scans are spread over cores."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_base: str | None = None
# Paths that the innermost scope removes; None outside of scopes.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local
    master may leave it unset, as tests do, and then gets a temporary folder;
    elsewhere each executor would write to a disk of its own.
    """
    global _local_base
    base = (spark.conf.get("spark.checkpoint.dir", None)
            or spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if _local_base is None:
            _local_base = tempfile.mkdtemp(prefix="revana-")
        base = _local_base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a shared Parquet table and read it back.

    Cuts the lineage, survives lost executors, and gives the planner the true
    size, so that it broadcasts the table only if it is really small.
    """
    out, path = written(df, name)
    if (made := _made.get()) is not None:
        made.append(path)
    return out


def written(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """The written table and its path, for a caller that removes it itself."""
    path = run_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``run_dir``, in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning: list[str | None] = []
_cleaning_lock = threading.Lock()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs inside remove what they shuffled as soon as they end, instead of when the
    driver next collects its garbage. For steps that run many times over."""
    with _cleaning_lock:
        if not _cleaning:
            _cleaning.append(spark.conf.get(_CLEANUP, None))
        _cleaning.append(None)
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _cleaning_lock:
            _cleaning.pop()
            if len(_cleaning) == 1:
                before = _cleaning.pop()
                spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are materialised inside are removed at the end.

    What is made of them must be written by then. Scopes can be nested, and each
    removes its own; threads started inside have none. Gives the list of paths.
    """
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        for path in made:
            remove(spark, path)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``operator`` with its result written and its own tables removed.

    For results that are small beside the tables they are made from. The written
    result belongs to the scope around the call, if there is one.
    """
    @functools.wraps(operator)
    def run(*args, **options) -> DataFrame:
        spark = SparkSession.active()
        around = _made.get()
        with scope(spark) as made:
            result = materialise(operator(*args, **options), operator.__name__)
            path = made.pop()
        if around is not None:
            around.append(path)
        return result
    return run


def pack(table: DataFrame, rows_per_task: int = 10_000) -> DataFrame:
    """Fewer partitions for a small table that an iterative fit reads hundreds
    of times, each time waiting for all its tasks. Pass a written table; a large
    one keeps its partitions."""
    wanted = max(1, -(-table.count() // rows_per_task))
    return table.coalesce(wanted) if wanted < table.rdd.getNumPartitions() else table


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Hash a scan that has fewer splits than the cluster has cores.

    A table of one row group is read by one task, which would then also do all
    the text work. Large tables have many splits and are left as they are. Pass
    a plain scan: asking for its partitions must not run a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, key)
