import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.operators import neighbors, sampling


@pytest.fixture(scope="module")
def points(spark):
    """Two classes; a third of the small one are copies of one point."""
    rng = np.random.default_rng(4)
    rows = [(i, 0, *map(float, rng.normal(size=2).round(3))) for i in range(300)]
    rows += [(1000 + i, 1, *map(float, (rng.normal(size=2) + 1).round(3))) for i in range(60)]
    rows += [(2000 + i, 1, 0.25, 0.5) for i in range(30)]
    return spark.createDataFrame(rows, "client_id long, y int, a double, b double").persist()


def test_split_is_exact_per_class(points):
    cut = sampling.split(points, "y", 0.2)
    assert {(r["y"], r["split"]): r["count"] for r in cut.groupBy("y", "split").count().collect()} == {
        (0, "test"): 60, (0, "train"): 240, (1, "test"): 18, (1, "train"): 72,
    }


def test_split_needs_identifying_columns(spark):
    df = spark.createDataFrame([(1, 0)] * 10, "client_id long, y int")
    with pytest.raises(ValueError):
        sampling.split(df, "y")


def test_largest_remainders():
    assert sampling.allocate({0: 5, 1: 5, 2: 5}, 4) == {0: 2, 1: 1, 2: 1}


def test_folds_cover_every_row_once(points):
    sizes = {(r["y"], r["fold"]): r["count"] for r in sampling.folds(points, "y", 4).groupBy("y", "fold").count().collect()}
    assert sorted(v for (y, _), v in sizes.items() if y == 0) == [75] * 4
    assert sorted(v for (y, _), v in sizes.items() if y == 1) == [22, 22, 23, 23]


def test_folds_of_tiny_classes(spark):
    df = spark.createDataFrame([(i, 0) for i in range(2)], "client_id long, y int")
    assert sorted(r["fold"] for r in sampling.folds(df, "y", 5).collect()) == [0, 1]


def test_time_blocks_never_look_ahead(spark):
    df = spark.range(97).select(F.col("id").alias("client_id"), F.timestamp_seconds(F.floor(F.col("id") / 30)).alias("t"))
    rows = sampling.time_folds(df, "t", 4).groupBy("block").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("t").alias("n")).orderBy("block").collect()
    assert len(rows) == 5 and {r["n"] for r in rows} <= {19, 20}
    assert all(x["b"] <= y["a"] for x, y in zip(rows, rows[1:]))


def test_over_and_undersampling_balance(points):
    over = sampling.oversample(points, "y").groupBy("y").count().collect()
    under = sampling.undersample(points, "y").groupBy("y").count().collect()
    assert {r["count"] for r in over} == {300} and {r["count"] for r in under} == {90}


def test_target_mapping(spark):
    def fit(*names):
        return sampling.fit_target(spark.createDataFrame([(n,) for n in names], "loyalty_category string"))

    assert fit("Отток", "Высоколояльные") == {"Отток": 0, "Высоколояльные": 1}
    assert fit("b", "a") == {"a": 0, "b": 1}
    assert fit("Отток", "Лояльные", "Высоколояльные")["Высоколояльные"] == 3
    assert sampling.class_names(sampling.FIVE_TO_FOUR)[0] == "Отток/Низколояльные"


def test_smote_points_lie_between_neighbours(points):
    made = sampling.smote(points, "y", ["a", "b"]).filter("is_synthetic").toPandas()
    assert len(made) == 210 and set(made["y"]) == {1}
    small = points.filter("y = 1").select("a", "b").toPandas().to_numpy()
    d = np.sqrt(((small[:, None] - small[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :5]
    reach = np.sort(d, axis=1)[:, 4]
    for x in made[["a", "b"]].to_numpy():
        found = False
        for i in range(len(small)):
            for j in np.flatnonzero(d[i] <= reach[i] + 1e-12):
                v, w = small[j] - small[i], x - small[i]
                n = v @ v
                g = (w @ v) / n if n else 0.0
                if -1e-9 <= g <= 1 + 1e-9 and np.abs(w - g * v).max() < 1e-9:
                    found = True
                    break
            if found:
                break
        assert found
    assert near.shape == (90, 5)


def test_smote_of_a_single_row_is_an_error(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 0, 2.0), (3, 1, 3.0)], "client_id long, y int, a double")
    with pytest.raises(ValueError):
        sampling.smote(df, "y", ["a"])


def test_tomek_links_against_brute_force(points):
    pdf = points.filter("client_id < 2000").toPandas()
    df = points.filter("client_id < 2000")
    x = pdf[["a", "b"]].to_numpy()
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    nn = d.argmin(axis=1)
    linked = {pdf["client_id"][i] for i in range(len(x)) if nn[nn[i]] == i and pdf["y"][i] != pdf["y"][nn[i]]}
    kept = {r["client_id"] for r in sampling.drop_tomek_links(df, "y", ["a", "b"]).collect()}
    assert linked and kept == set(pdf["client_id"]) - linked


def test_copies_of_two_classes_link(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0), (3, 0, 9.0), (4, 0, 9.0)], "client_id long, y int, a double").coalesce(1)
    assert sorted(r["client_id"] for r in sampling.drop_tomek_links(df, "y", ["a"]).collect()) == [3, 4]


@pytest.mark.parametrize("cell_rows", [60, 5000])
def test_nearest_neighbours_against_brute_force(spark, monkeypatch, cell_rows):
    """Clumped data: small blocks are visited by many rows, and the query side is salted."""
    monkeypatch.setattr(neighbors, "QUERY_ROWS", 100)
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(scale=0.01, size=(300, 3)), rng.normal(size=(300, 3)) * 5])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vector array<double>")
    got = {r["id"]: [n["id"] for n in r["neighbours"]] for r in neighbors.nearest(df, 4, cell_rows).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert got == {i: list(row) for i, row in enumerate(want)}


@pytest.mark.parametrize("n", [2_000, 16_000])
def test_rows_meet_few_blocks_however_large_the_table(spark, monkeypatch, n):
    """Evenly spread rows: the blocks a row visits do not grow with the table.

    Blocks cut along one axis only were visited by more rows the more of them there were.
    """
    written = {}
    plain = neighbors.materialize
    monkeypatch.setattr(neighbors, "materialize", lambda df, label: written.setdefault(label, plain(df, label)))
    x = np.random.default_rng(7).uniform(size=(n, 3))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vector array<double>")
    assert neighbors.nearest(df, 2, 50).count() == n
    assert written["visits"].count() < 3 * n


def _plain_top(ids, x, other_ids, others, k):
    """The k nearest of every row from all differences, one dimension at a time."""
    d = np.zeros((len(x), len(others)))
    for j in range(x.shape[1]):
        d += (x[:, j, None] - others[None, :, j]) ** 2
    d = np.sqrt(d)
    d[ids[:, None] == other_ids[None, :]] = np.inf
    lists = []
    for row in d:
        order = np.lexsort((other_ids, row))[:k]
        lists.append([{"distance": float(row[o]), "id": int(other_ids[o])} for o in order if np.isfinite(row[o])])
    return lists


@pytest.mark.parametrize("kind", ["plain", "ties", "far off", "odd", "huge", "tiny"])
@pytest.mark.parametrize("k", [1, 5])
def test_search_in_a_block_is_exact(kind, k):
    """Sums of squares from a matrix product are rounded; they must not decide who is nearest."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6))
    if kind == "ties":
        x = rng.integers(0, 3, size=(300, 6)).astype(float)
    elif kind == "far off":
        x = 1e9 + x * 1e-3
    elif kind == "odd":
        x[3, 2], x[7, 1], x[9, 0] = np.nan, np.inf, -np.inf
    elif kind == "huge":
        x[3], x[4], x[5] = x[3] * 1e160, x[4] * 1e300, 1e155
    elif kind == "tiny":
        x = x * 1e-165
    ids = rng.permutation(300) * 3
    with np.errstate(all="ignore"):
        want = _plain_top(ids, x, ids, x, k)
    assert neighbors._top(ids, x, ids, x, k) == want


def test_search_in_a_block_sums_few_pairs_by_dimension(monkeypatch):
    """A matrix product finds who may be near; it was every pair of rows before."""
    pairs, plain = [], neighbors._distances

    def counted(a, b, i, j):
        pairs.append(len(i))
        return plain(a, b, i, j)

    monkeypatch.setattr(neighbors, "_distances", counted)
    x, ids = np.random.default_rng(9).normal(size=(1_500, 37)), np.arange(1_500)
    assert neighbors._top(ids, x, ids, x, 5) == _plain_top(ids, x, ids, x, 5)
    assert sum(pairs) < 6 * len(x)


def test_rows_that_visit_no_other_block_are_not_written_again(spark, monkeypatch):
    """Two far clumps of one block each: no visit, and each visit is a row of its own, not a list."""
    written = {}
    plain = neighbors.materialize
    monkeypatch.setattr(neighbors, "materialize", lambda df, label: written.setdefault(label, plain(df, label)))
    x = np.random.default_rng(10).normal(size=(120, 3)) + np.repeat([0, 1e6], 60)[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vector array<double>")
    assert neighbors.nearest(df, 2, 60).count() == 120
    assert written["visits"].count() == 0


def test_vectors_are_grouped_in_a_hash_table(spark, points, monkeypatch):
    """The smallest (id, label) pair of a vector had all rows sorted by their features."""
    plans = []
    plain = sampling.materialize

    def recorded(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, label)

    monkeypatch.setattr(sampling, "materialize", recorded)
    sampling.drop_tomek_links(points, "y", ["a", "b"]).count()
    assert any("HashAggregate" in p for p in plans) and not any("SortAggregate" in p for p in plans)


def test_copies_of_many_classes_link_their_two_smallest_ids(spark):
    rows = [(1, 0, 1.0), (2, 0, 1.0), (3, 1, 1.0), (4, 1, 5.0), (5, 0, 5.0), (6, 0, 5.0), (7, None, 9.0), (8, 1, 9.0)]
    df = spark.createDataFrame(rows, "client_id long, y int, a double").coalesce(1)
    assert sorted(r["client_id"] for r in sampling.drop_tomek_links(df, "y", ["a"]).collect()) == [1, 2, 3, 6, 7, 8]


def test_rebalance_methods(points):
    scored = points.withColumn("loyalty_score", (F.col("a") - F.lit(-5)) / 12)
    df, label, recut = sampling.rebalance(scored, "boundary", "y")
    assert label == "balanced_target" and df.select(label).distinct().count() == 4
    assert sampling.rebalance(scored, "none", "y")[0] is scored
    with pytest.raises(ValueError):
        sampling.rebalance(scored, "magic", "y")


def _segment_of(x, small, reach_k=5):
    """True if ``x`` lies between a row of ``small`` and one of its ``reach_k`` nearest rows."""
    d = np.sqrt(((small[:, None] - small[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    reach = np.sort(d, axis=1)[:, reach_k - 1]
    for i in range(len(small)):
        for j in np.flatnonzero(d[i] <= reach[i] + 1e-12):
            v, w = small[j] - small[i], x - small[i]
            n = v @ v
            g = (w @ v) / n if n else 0.0
            if -1e-9 <= g <= 1 + 1e-9 and np.abs(w - g * v).max() < 1e-6 * (1 + np.abs(small).max()):
                return True
    return False


def test_all_feature_queries_against_brute_force(spark):
    """The registered queries on all model features: Tomek links and SMOTE neighbours by plain numpy."""
    import __spark_entry__ as entry
    from checks import stages

    folder = "/root/testdata/sf0.001"
    df = stages.targeted(spark, folder)
    features = sampling.model_features(df)
    assert len(features) > 30
    pdf = df.select("client_id", "loyalty_target", *features).toPandas().sort_values("client_id").reset_index(drop=True)
    x = pdf[features].to_numpy(dtype=float)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    nn = d.argmin(axis=1)  # ties: the smaller id, as rows are in id order
    y = pdf["loyalty_target"].to_numpy()
    linked = {pdf["client_id"][i] for i in range(len(x)) if nn[nn[i]] == i and y[i] != y[nn[i]]}
    kept = {r["client_id"] for r in entry.queries()["tomek_all_features"](spark, folder).collect()}
    assert kept == set(pdf["client_id"]) - linked

    made = entry.queries()["smote_all_features"](spark, folder).toPandas()
    counts = pdf["loyalty_target"].value_counts()
    assert len(made) == sum(counts.max() - n for n in counts)
    for label, group in made.groupby("loyalty_target"):
        small = x[y == label]
        for point in group[features].to_numpy(dtype=float)[:40]:
            assert _segment_of(point, small)
