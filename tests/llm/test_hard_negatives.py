"""Hard negatives against all pairs, zone maps against their rows, the curve against its definition."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from revana.llm import hard_negatives
from revana.llm.hard_negatives import bounds, hilbert_keys, mine

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, step):
    """Counter-like sorted list of results, one per anchor row."""
    kept = []
    for vec_id, vec, label in rows:
        if None in (vec_id, vec, label) or any(x is None or not math.isfinite(x) for x in vec):
            continue
        q = [math.floor(max(-2.0 ** 24, min(2.0 ** 24, float(np.float32(x)) * 256))) for x in vec]
        kept.append((vec_id, label, q))
    out = []
    for a, label, q in kept:
        if a % step:
            continue
        scores = [(-sum(x * y for x, y in zip(q, r)), i, l) for i, l, r in kept if i != a]
        for rank, (p, i, _) in enumerate(sorted(s for s in scores if s[2] == label)[:5], 1):
            fits = sorted(s for s in scores if s[2] != label and -50 * p <= -100 * s[0] <= -95 * p)[:3]
            out += [(a, i, rank, n, j, -p, -s) for n, (s, j, _) in enumerate(fits, 1)]
    return sorted(out)


def rows_of(found):
    return sorted(map(tuple, found.collect()))


def clustered(seed, n, dims=8, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims)) * 2
    vectors = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dims)) * 0.3
    return [(i, [float(np.float32(x)) for x in v], int(rng.integers(0, labels))) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("block, group, zones", [(512, 256, 1024), (16, 4, 3)])
def test_equal_to_all_pairs(spark, monkeypatch, block, group, zones):
    for name, value in (("BLOCK", block), ("GROUP", group), ("ZONES", zones), ("GROUPS_A_TASK", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = clustered(1, 400) + [(400 + i, [0.5] * 8, i % 2) for i in range(40)]      # ties
    assert rows_of(mine(spark.createDataFrame(rows, VECTORS), F.col("id") % 20 == 0)) == brute(rows, 20)


def test_zone_maps_leave_blocks_out(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("GROUP", 4), ("ZONES", 8)):
        monkeypatch.setattr(hard_negatives, name, value)
    read = []
    chosen = hard_negatives.chosen_blocks

    def counted(groups, zones, *rest):
        found = chosen(groups, zones, *rest)
        read.append((found.count(), groups.join(zones.select("chunk", "salt", F.size("zones").alias("n")), ["chunk", "salt"])
                     .agg(F.sum("n")).first()[0]))
        return found

    monkeypatch.setattr(hard_negatives, "chosen_blocks", counted)
    rows = [(i, v, i % 5 // 4) for i, v, _ in clustered(2, 3000, dims=4)]
    assert rows_of(mine(spark.createDataFrame(rows, VECTORS), F.col("id") % 100 == 0)) == brute(rows, 100)
    # Positives in both rounds, then negatives in both.
    assert len(read) == 4
    assert read[0][0] + read[1][0] < 0.5 * read[0][1]
    assert read[2][0] + read[3][0] < 0.7 * read[2][1]


def test_bounds_hold():
    rng = np.random.default_rng(3)
    anchors, rows = rng.integers(-300, 300, (20, 16)), rng.integers(-300, 300, (50, 16))
    least, most = bounds(anchors, rows.min(axis=0)[None], rows.max(axis=0)[None])
    products = anchors @ rows.T
    assert (products >= least).all() and (products <= most).all()
    one_least, one_most = bounds(anchors, rows[:1], rows[:1])
    assert (one_least == products[:, :1]).all() and (one_most == products[:, :1]).all()
    large = np.full((2, 64), 1 << 24)
    assert (bounds(large, large, large)[0] == 64 << 48).all()


@pytest.mark.parametrize("dims, bits", [(1, 4), (2, 4), (3, 3), (5, 2)])
def test_curve_visits_each_cell_once_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = [bytes(k) for k in hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=lambda i: keys[i])]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], i % 2) for i in range(60)]
    rows += [(None, [1.0] * 6, 0), (60, None, 0), (61, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (62, [float("nan")] * 6, 1),
             (63, [float("-inf")] * 6, 1), (64, [1.0] * 6, None), (65, [0.0] * 6, 0), (66, [], 1), (70, [], 0), (67, [0.5, 0.5], 1),
             (68, [3e38, -3e38, 1e30, 0.0, 1.0, 2.0], 1), (69, [3e38, -3e38, 0.0, 0.0, 1.0, 2.0], 0), (80, [3e38] * 6, 0), (90, [2e38] * 6, 0),
             (20, [0.9] * 6, 0), (20, [0.9] * 6, 1), (21, rows[21][1], 1)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS id", "2 AS q", "3 AS place", "4 AS grp", "5 AS score")
    assert rows_of(mine(table, F.col("id") % 10 == 0)) == brute(rows, 10)


def test_empty_and_single(spark):
    assert rows_of(mine(spark.createDataFrame([], VECTORS), F.col("id") % 10 == 0)) == []
    assert rows_of(mine(spark.createDataFrame([(0, None, 1)], VECTORS), F.col("id") % 10 == 0)) == []
    assert rows_of(mine(spark.createDataFrame([(0, [1.0], 1)], VECTORS), F.col("id") % 10 == 0)) == []
    assert rows_of(mine(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 1)], VECTORS), F.col("id") % 10 == 0)) == []
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)]
    assert rows_of(mine(spark.createDataFrame(rows, VECTORS), F.col("id") % 10 == 0)) == [(0, 1, 1, 1, 2, 65536, 58880)]
