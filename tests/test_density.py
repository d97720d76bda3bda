"""Kernel densities per category: many categories, a null one, against a plain computation."""

import math

import numpy as np

from retentio.operators import profile


def test_many_categories_and_a_null_one(spark):
    rng = np.random.default_rng(1)
    rows = [(None if c == 0 else f"c{c}", float(v)) for c in range(150) for v in rng.normal(c, 1 + c % 3, size=7)]
    rows += [("one", 3.0), ("flat", 2.0), ("flat", 2.0)]  # no curve: a single value, no spread
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["point"]): r["density"] for r in profile.density(df, "v", 5, by="g").collect()}
    assert len(got) == 150 * 5
    for key in (None, "c7", "c149"):
        x = np.array([v for g, v in rows if g == key])
        n, h = len(x), x.std(ddof=1) * len(x) ** -0.2
        for i in range(5):
            g = x.min() + i * (x.max() - x.min()) / 4
            want = np.exp(-0.5 * ((x - g) / h) ** 2).sum() / (n * h * math.sqrt(2 * math.pi))
            assert abs(got[(key, i)] - want) < 1e-9
