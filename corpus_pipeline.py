"""A training corpus in five stages: language ID, near-dedup, passage dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``. Between stages the documents are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from revana.llm import language_id, mixing, near_dedup, packing, suffix_dedup
from revana.llm.common import is_row, table
from revana.workspace import remove, run_dir, scope

# A text this far from every profile is in none of the languages: noise shares
# hardly any n-gram with a profile, prose of a known language half of them.
LEAST_SCORE = 0.2
SHINGLE = 5         # words


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; texts without letters and noise go."""
    found = language_id.identify(docs, ~is_row("doc_id", 4, 2))
    keep = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return found.filter(keep).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates, and all without one.

    Documents are named by id and text, so a null or repeated id is no reason to
    go or to stay: the first is by id, null last, then by hash. Of rows with equal
    id and text one stays, all of those without words.
    """
    words = F.coalesce(F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]"), F.lit(False))
    own = [F.col(c) for c in docs.columns]
    named = docs.filter(words).withColumn("_name", F.xxhash64("doc_id", "text"))
    found = near_dedup.near_duplicates(named.select(F.col("_name").alias("doc_id"), "text"), width=SHINGLE)
    found = found.select(F.col("doc_id").alias("_name"), "component_id").distinct()
    ids = named.select("_name", "doc_id").distinct()
    first = (ids.join(found, "_name").groupBy("component_id")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_name"))["_name"].alias("_name")))
    # Rows of one name are equal in id and text; the minimum is taken before the shuffle.
    kept = (named.join(first, "_name", "left_semi").groupBy("_name").agg(F.min(F.struct(*own)).alias("_row"))
            .select("_row.*"))
    return kept.select(*docs.columns).unionByName(docs.filter(~words))


def passages_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat. A document of which no more than blanks
    is left goes; one that was not cut stays, also if its text is null or empty."""
    cut = suffix_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture of sources uses them. Rows that repeat
    are used each; null sources are a source of their own; an empty table stays empty."""
    mixed, _ = mixing.mix(docs)
    return mixing.realise(mixed).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences. Null and
    empty texts are one piece with the end id; a document that the mixture repeats is
    packed each time; an empty table gives no pieces. Extra columns are ignored."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_near_copies),
    ("suffix_dedup", passages_once),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

# Profiles, suffix arrays, bisection and the linear program are not SQL; the
# rows of run() are tested against plain Python on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. What a stage makes on its way is removed when its
    documents are written, and these when the next ones are."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = run_dir(spark, name)
        with scope(spark):
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
