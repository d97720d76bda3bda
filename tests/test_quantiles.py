import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.operators import quantiles
from retentio.operators.ranking import percent_ranks, running_total, with_row_index

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


@pytest.mark.parametrize("kind", ["distinct", "third_equal", "two_values", "constant"])
@pytest.mark.parametrize("limit", [20, 100_000])
def test_quantiles_match_numpy(spark, monkeypatch, kind, limit):
    """A tiny fetch limit forces the sketch and several narrowing passes."""
    monkeypatch.setattr(quantiles, "DIRECT_LIMIT", limit)
    monkeypatch.setattr(quantiles, "FETCH_LIMIT", limit)
    rng = np.random.default_rng(1)
    values = {
        "distinct": rng.normal(size=3000),
        "third_equal": np.concatenate([np.full(1000, 0.5), rng.random(2000)]),
        "two_values": rng.integers(0, 2, 3000).astype(float),
        "constant": np.full(500, 3.0),
    }[kind]
    df = frame(spark, [*values, None, None])
    got = quantiles.exact_quantiles(df, ["x"], SHARES)["x"]
    assert got == pytest.approx([np.quantile(values, p) for p in SHARES], abs=1e-12)


def test_quantiles_of_nothing(spark):
    assert quantiles.exact_quantiles(frame(spark, [None, None]), ["x"], [0.5]) == {"x": [None]}


@pytest.mark.parametrize("limit", [5, 1000])
def test_rank_values_keep_long_precision(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "DIRECT_LIMIT", limit)
    monkeypatch.setattr(quantiles, "FETCH_LIMIT", 1000)
    big = [2**59 + i for i in range(50)]
    df = spark.createDataFrame([(v,) for v in reversed(big)], "x long")
    assert quantiles.rank_values(df, {"x": (F.col("x"), [0, 7, 49, 50])})["x"] == {0: big[0], 7: big[7], 49: big[49], 50: None}


def test_grouped_quantiles_with_a_crowded_key(spark):
    rng = np.random.default_rng(2)
    rows = [(1, float(v), None) for v in rng.integers(0, 50, 900)] + [(int(k), float(v), float(v)) for k, v in zip(rng.integers(2, 20, 600), rng.normal(size=600))]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    plain = {r["k"]: (r["a"], r["b"]) for r in quantiles.grouped_quantiles(df, ["k"], ["a", "b"], 0.5).collect()}
    split = {r["k"]: (r["a"], r["b"]) for r in quantiles.grouped_quantiles(df, ["k"], ["a", "b"], 0.5, group_limit=100).collect()}
    assert plain == split and len(plain) == 19


def test_running_total_and_index(spark):
    values = np.random.default_rng(3).permutation(500)
    df = spark.createDataFrame([(int(v % 3), int(v), 1) for v in values], "k int, v int, one int")
    for row in running_total(df, ["v"], {"upto": "one"}, ["k"]).collect():
        assert row["upto"] == row["v"] // 3 + 1
    index = with_row_index(df, [F.desc("v")]).collect()
    assert all(r["_index"] == 499 - r["v"] for r in index)


def test_percent_ranks_with_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,)], "x double")
    got = sorted(r["x_percent_rank"] for r in percent_ranks(df, ["x"]).collect())
    assert got == pytest.approx([0, 1 / 3, 1 / 3, 1])


def test_lists_are_fetched_from_bracket_rows_only(spark, monkeypatch):
    """Counting does not run with the lists: that aggregate sees only rows inside a bracket."""
    seen = []
    plain = quantiles.F.collect_list
    monkeypatch.setattr(quantiles.F, "collect_list", lambda c: seen.append(c) or plain(c))
    df = frame(spark, [1.0] * 40 + [2.0] * 60)
    found = quantiles.rank_values(df, {"x": (F.col("x"), [10, 50])})
    assert found == {"x": {10: 1.0, 50: 2.0}}
    assert not seen  # nothing lies strictly between, so there is nothing to fetch
