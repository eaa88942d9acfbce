"""Pair counts against a plain count; rows out bounded by distinct pairs."""

import random
from collections import Counter
from itertools import combinations

import pytest

from revana.operators import products, terms


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["é", "漢"]
    texts = [[rng.choice(words[:rng.choice([5, 50, 302])]) for _ in range(rng.choice([0, 1, 3, 40, 400]))] for _ in range(150)]
    return texts + [None, [], [None, "w1", None, "w2"], ["w1"] * 50]


def plain(docs, words):
    n = Counter()
    for tokens in docs:
        n.update(combinations(sorted({t for t in tokens or () if t in words}), 2))
    return dict(n)


@pytest.mark.parametrize("cells, step", [(1 << 22, 1 << 22), (500, 700)])
def test_pairs_equal_a_plain_count(spark, docs, monkeypatch, cells, step):
    monkeypatch.setattr(products, "CELLS", cells)
    monkeypatch.setattr(products, "STEP", step)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id int, tokens array<string>, src string")
    words = [f"w{i}" for i in range(0, 300, 2)] + ["w1", "é", "漢", "absent", "w1"]
    got = {(r.src, r.dst): r.n_docs for r in products.pair_counts(df, words).collect()}
    assert got == plain(docs, set(words))
    assert products.pair_counts(df.limit(0), words).count() == 0 and products.pair_counts(df, []).count() == 0


def test_rows_out_are_bounded_by_distinct_pairs(spark):
    same = [[f"w{i}" for i in range(200)]] * 400            # 400 * 19,900 pairs, 19,900 distinct
    df = spark.createDataFrame([(t,) for t in same], "tokens array<string>").repartition(4)
    found = products.pair_counts(df, [f"w{i}" for i in range(200)])
    product = found._jdf.queryExecution()
    assert found.count() == 19_900 and {r.n_docs for r in found.collect()} == {400}
    assert "MapInArrow" in product.executedPlan().toString()


def test_both_plans_agree(spark, docs, monkeypatch):
    df = spark.createDataFrame([(t,) for t in docs], "tokens array<string>")
    frequency = terms.meaningful(terms.word_frequency(df))
    few = sorted(map(tuple, terms.cooccurrence_edges(df, frequency, 60).collect()))
    monkeypatch.setattr(terms, "FEW_WORDS", 1)
    assert few == sorted(map(tuple, terms.cooccurrence_edges(df, frequency, 60).collect()))


def test_matrix_and_sparse_sums_agree_and_tasks_hand_on_each_row_once(spark, docs, monkeypatch):
    df = spark.createDataFrame([(t,) for t in docs], "tokens array<string>").repartition(40)
    words = [f"w{i}" for i in range(0, 300, 3)]
    found = products.pair_counts(df, words)
    assert {(r.src, r.dst): r.n_docs for r in found.collect()} == plain(docs, set(words))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce 8" in plan and "HashAggregate" not in plan.split("BroadcastExchange")[0]
    monkeypatch.setattr(products, "DENSE", 0)
    assert sorted(found.collect()) == sorted(products.pair_counts(df, words).collect())
