"""Every registered query against its SQL, or for invariants where it has none."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == []


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 30 and rows[0]["频率"] >= rows[-1]["频率"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name,joins", [
    ("graph_edges", 0), ("word_frequency", 1), ("document_terms", 1), ("dedup_reviews", 1),
    ("exact_split", 1), ("topic_terms", 5)])
def test_plans_have_no_product_and_few_joins(spark, name, joins):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    main = plan.split("Subquery")[0]
    assert main.count("Join") <= joins


def test_text_is_tokenised_once(spark):
    # The executed plan does not print what an aggregate computes from its result.
    plan = entry.queries()["word_frequency"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_topic_cut_is_made_before_the_shuffle(spark):
    plan = entry.queries()["topic_terms"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
