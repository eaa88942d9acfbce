"""Intermediate tables are removed once what is made of them is written."""

import itertools
import os

import pytest

from revana import workspace
from revana.workspace import materialise, scope, tidy


@pytest.fixture
def shared(spark, tmp_path, monkeypatch):
    numbers = itertools.count()
    monkeypatch.setattr(workspace, "run_dir", lambda spark, name: f"file://{tmp_path}/{name}-{next(numbers)}")
    return tmp_path


def test_without_a_scope_tables_stay(spark, shared):
    assert materialise(spark.range(5), "five").count() == 5
    assert len(os.listdir(shared)) == 1


def test_scopes_remove_their_own_tables_only(spark, shared):
    with scope(spark):
        outer = materialise(spark.range(5), "outer")
        with scope(spark):
            materialise(spark.range(6), "inner")
            assert len(os.listdir(shared)) == 2
        assert outer.count() == 5
        assert len(os.listdir(shared)) == 1
    assert os.listdir(shared) == []


def test_a_failure_leaves_nothing(spark, shared):
    with pytest.raises(ZeroDivisionError):
        with scope(spark):
            materialise(spark.range(5), "five")
            1 / 0
    assert os.listdir(shared) == []
    assert workspace._made.get() is None


def test_tidy_operators_leave_their_result(spark, shared):
    @tidy
    def inner(df):
        """Doubled."""
        return materialise(df, "copy").union(materialise(df, "other"))

    @tidy
    def outer(df):
        return inner(df).union(materialise(df, "third"))

    assert inner.__doc__ == "Doubled."
    found = outer(spark.range(4))
    assert len(os.listdir(shared)) == 1 and os.listdir(shared)[0].startswith("outer-")
    assert found.count() == 12
    with scope(spark):
        assert inner(spark.range(4)).count() == 8
    assert len(os.listdir(shared)) == 1
