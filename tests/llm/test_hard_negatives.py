"""Hard negatives against all scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginflow.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, row string, v string, dim string, chunk int"


def expected(rows, every, positives=5, negatives=5):
    usable = [
        (i, [math.floor(256 * x) for x in v], la)
        for i, v, la in rows
        if i is not None and la is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (anchor, v, label) in enumerate(usable):
        if anchor % every:
            continue
        scored = [
            (sum(x * y for x, y in zip(v, w)), i, la)
            for b, (i, w, la) in enumerate(usable)
            if a != b and len(w) == len(v)
        ]
        near = sorted(((s, i) for s, i, la in scored if la == label), key=lambda t: (-t[0], t[1]))[:positives]
        far = sorted(((s, i) for s, i, la in scored if la != label), key=lambda t: (-t[0], t[1]))
        for score, i in near:
            inside = [(s, n) for s, n in far if 80 * score <= 100 * s <= 100 * score][:negatives]
            out += [(anchor, i, r + 1, n, score, s) for r, (s, n) in enumerate(inside)]
    return sorted(out)


def mined(spark, rows, every):
    table = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA).repartition(3)
    vectors = hard_negatives.quantised(table)
    return sorted(tuple(r) for r in hard_negatives.mine(vectors, F.col("vec_id") % every == 0).collect())


@pytest.mark.parametrize("cell", [64, 1 << 19])
def test_equals_all_scores(spark, monkeypatch, cell):
    """Ties, repeated ids, a vector held by a third of all rows, other lengths, rows that take no part."""
    monkeypatch.setattr(hard_negatives, "CELL", cell)
    drawn = random.Random(3)
    common = [0.4, 0.1, -0.2, 0.3, 0.0, 0.2, 0.1, -0.1, 0.5, 0.25]
    rows = [(i, common if i % 3 == 0 else [drawn.gauss(0, 0.3) for _ in common], drawn.randrange(3)) for i in range(150)]
    rows += [(30, common, 1), (30, common, 1), (31, rows[31][1], 2), (None, common, 1), (300, None, 1), (310, common, None)]
    rows += [(320, [*common[:9], float("nan")], 0), (330, [*common[:9], None], 0), (340, [float("inf"), *common[1:]], 1)]
    rows += [(350 + i, [drawn.gauss(0, 1) for _ in range(3)], i % 2) for i in range(20)]
    rows += [(400, [0.0] * 10, 0), (410, [], 1), (411, [], 0), (420, [1.0], 5)]
    found = mined(spark, rows, 10)
    assert found == expected(rows, 10)
    assert len(found) > 100


def test_huge_components(spark):
    rows = [(i, [2e5 * (i + 1) + 0.01, -3e4 * i, 0.5], i % 2) for i in range(12)]
    assert mined(spark, rows, 1) == expected(rows, 1)
    saturated = mined(spark, [(0, [1e300], 0), (1, [1e300], 0), (2, [1e300], 1)], 1)
    assert {r[4] for r in saturated} == {(1 << 63) - 1}


def test_no_rows(spark):
    assert mined(spark, [(0, None, 1)], 1) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)], 10) == []


def test_index_leaves_out_no_row():
    """Every row that reaches a threshold is found, though the index omits dimensions and rows leave early."""
    rng = np.random.default_rng(7)
    rows = rng.integers(-80, 80, (500, 40)) * (np.arange(40) < rng.integers(1, 41, (500, 1)))
    queries = rng.integers(-80, 80, (20, 40))
    scores = rows @ queries.T
    for least in (scores.max() * 0.9, scores.max() / 2, 0.0, float("-inf")):
        index = hard_negatives.Index(rows, queries, least)
        for at, query in enumerate(queries):
            for threshold in (least, least + 500):
                reach = np.nonzero(scores[:, at] >= threshold)[0]
                found = index.reaching(query, threshold)
                assert set(reach) <= set(found)
                assert (index.scores(query, found) == scores[found, at]).all()
    assert sum(index.held) == 500 * len(index.groups)  # no threshold: nothing is omitted
    strict = hard_negatives.Index(rows, queries, scores.max() * 0.9)
    assert sum(strict.held) < 500 * len(strict.groups)
    assert len(strict.reaching(queries[0], scores.max() * 0.9)) < 500
