"""Exact top-k search against a plain all-pairs computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.llm import topk


def brute(rows, every, k):
    order = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        order.append((i, [math.floor(1024 * x) for x in v]))
    out = []
    for qi, qv in order:
        if qi % every:
            continue
        scored = sorted(
            ((-sum(a * b for a, b in zip(qv, cv)), ci) for ci, cv in order if ci != qi),
        )[:k]
        out += [(qi, r + 1, ci, -s) for r, (s, ci) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, every=5, k=3, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = topk.integer_vectors(df.withColumn("vec_id_2", F.lit(1)), "vec_id", "embedding")
    found = topk.top_k(vectors, F.col("_id") % every == 0, k, **kw)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("kw", [{}, {"chunk_rows": 7, "query_rows": 3, "head": 4, "coord_above": 0.0}, {"chunk_rows": 5, "coord_above": 2.0}])
def test_against_brute_force(spark, kw):
    g = np.random.default_rng(3)
    vectors = g.normal(size=(120, 6))
    vectors[:40] *= g.uniform(0.1, 3.0, size=(40, 1))  # norms that differ, so bands prune
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    assert run(spark, rows, **kw) == brute(rows, 5, 3)


def test_ties_repeats_and_bad_rows(spark):
    rows = [
        (0, [1.0, 0.0]),
        (1, [0.5, 0.5]),
        (2, [0.5, 0.5]),  # tie with 1: smaller id first
        (3, [0.5, 0.5]),
        (3, [0.5, 0.5]),  # a repeated row is a candidate twice
        (4, None),
        (5, [float("nan"), 1.0]),
        (6, [1.0, None]),
        (None, [9.0, 9.0]),
        (7, []),  # empty: norm 0, scores 0
        (8, [2.0]),  # shorter: common prefix
        (10, [float("inf"), 0.0]),
    ]
    got = run(spark, rows, every=1, k=4)
    assert got == brute(rows, 1, 4)
    assert [r for r in got if r[0] == 0][:2] == [(0, 1, 8, 2097152), (0, 2, 1, 524288)]


def test_empty_and_few(spark):
    assert run(spark, [], every=1) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])], every=1, k=10) == [(0, 1, 1, 2097152), (1, 1, 0, 2097152)]
