"""Repeated and absent ids, equal branches, shared folders."""

import pytest
from pyspark.sql import functions as F

from revana import workspace
from revana.operators import lda, lookup, tokens
from revana.operators.dedup import dedup_first


@pytest.mark.parametrize("rows,kept", [
    ([("id1", "A"), ("id1", "B"), ("id0", "B")], [("id0", "B"), ("id1", "A")]),
    ([(None, "A"), ("id1", "B")], [(None, "A"), ("id1", "B")]),
    ([("id1", "A"), ("id1", "A"), (None, "A")], [("id1", "A")]),
    ([("id1", None), ("id2", None)], [("id1", None)])])
def test_every_text_keeps_one_row(spark, rows, kept):
    df = spark.createDataFrame(rows, "comment_id string, content string")
    got = sorted(map(tuple, dedup_first(df, "content", "comment_id").collect()), key=str)
    assert got == sorted(kept, key=str)


def test_shared_folder_is_asked_for_off_local(monkeypatch):
    class Session:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="share"):
        workspace.run_dir(Session, "x")


def test_lookup_is_the_same_with_a_small_head_and_sorts_nothing(spark):
    facts = spark.range(3000).select((F.col("id") % 97).cast("string").alias("word"), "id")
    table = spark.range(90).select(F.col("id").cast("string").alias("word"), (F.col("id") + 1).alias("n"))
    whole = lookup.union_all(lookup.word_lookup(facts, table))
    parts = lookup.word_lookup(facts, table, limit=10)
    split = lookup.union_all(parts)
    assert sorted(map(tuple, whole.select("word", "id", "n").collect())) == sorted(
        map(tuple, split.select("word", "id", "n").collect()))
    assert "TakeOrdered" not in split._jdf.queryExecution().executedPlan().toString()


def test_stop_word_branches_agree(spark, monkeypatch):
    rows = [(1, ["a", "b", None, "a"]), (1, ["c"]), (2, None), (3, []), (None, ["a"]), (1, ["c"])]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    for stop in (["b", "a"], []):
        inline = tokens.remove_stopwords(df, stop).collect()
        monkeypatch.setattr(tokens, "INLINE_STOPWORDS", -1)
        words = spark.createDataFrame([(w,) for w in stop], "word string")
        joined = tokens.remove_stopwords(df, words).select(*df.columns).collect()
        monkeypatch.undo()
        assert sorted(map(str, inline)) == sorted(map(str, joined))


def test_every_document_reaches_the_topic_model(spark):
    df = spark.createDataFrame([(i, ["the", f"own{i}"] * 3) for i in range(300)], "doc_id long, tokens array<string>")
    corpus = lda.build_corpus(df)
    weights = [sum(r.w) for r in lda.fit_topics(corpus, 3).weights.collect()]
    corpus.release()
    assert len(weights) == 301 and all(w > 1.0 + 2.9 for w in weights)      # the prior and three occurrences


def test_repeated_ids_are_one_document(spark):
    df = spark.createDataFrame([("x", ["p", "q"]), ("x", ["p"]), ("y", ["q"])], "doc_id string, tokens array<string>")
    corpus = lda.build_corpus(df)
    entries = corpus.entries().collect()
    corpus.release()
    assert corpus.n_tokens == 4 and corpus.n_docs == 2
    assert sorted(r.n for r in entries) == [1, 1, 2] and len({(r.block, r.doc) for r in entries}) == 2
