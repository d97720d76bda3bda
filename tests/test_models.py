import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.models import classifiers, training
from retentio.operators import clusters, evaluation, importance
from retentio.operators.importance import with_donor
from retentio.plans.stages import assemble

FEATURES = ["a", "b", "noise"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    three = np.digitize(x[:, 0] + 0.5 * x[:, 1], [-0.5, 0.5])
    rows = [(i, int(three[i] > 0), int(three[i]), *map(float, x[i])) for i in range(400)]
    return spark.createDataFrame(rows, "client_id long, two int, three int, a double, b double, noise double").persist()


SPECS = {
    "logistic": classifiers.custom_spec("logistic", maxIter=20),
    "forest": classifiers.custom_spec("forest", numTrees=8, maxDepth=5),
    "boosting": classifiers.custom_spec("boosting", maxIter=4),
    "margin": classifiers.custom_spec("margin", maxIter=10),
}


@pytest.mark.parametrize("target", ["two", "three"])
def test_models_score_save_and_load(spark, data, tmp_path, target):
    table = assemble(data, FEATURES, target).persist()
    models, seconds = training.train_all(SPECS, table)
    assert set(seconds) == set(SPECS)
    for name, model in models.items():
        out = model.transform(table).select("label", "prediction", F.aggregate("scores", F.lit(0.0), lambda s, v: s + v).alias("s")).toPandas()
        assert (out["label"] == out["prediction"]).mean() > 0.75, name
        assert np.allclose(out["s"], 1.0), name
        model.save(str(tmp_path / name))
        again = classifiers.load(str(tmp_path / name)).transform(table)
        assert again.select("prediction").toPandas()["prediction"].tolist() == out["prediction"].tolist()
        assert len(model.importances()) == len(FEATURES) or name == "margin"


def test_ensembles(data, tmp_path):
    table = assemble(data, FEATURES, "three").persist()
    specs = {k: SPECS[k] for k in ("logistic", "forest")}
    stacked = training.stacking_ensemble(specs, table, k=2)
    assert evaluation.metric_values(stacked.transform(table))["accuracy"] > 0.75
    stacked.save(str(tmp_path / "stack"))
    loaded = classifiers.load(str(tmp_path / "stack")).transform(table)
    assert loaded.select("prediction").collect() == stacked.transform(table).select("prediction").collect()
    hard = training.voting_ensemble(specs, table, "hard").transform(table)
    assert hard.filter(F.array_max("scores") > 1).isEmpty()


def test_unknown_learner():
    with pytest.raises(ValueError):
        classifiers.custom_spec("oracle")


def test_search_is_seeded_and_finds_the_better_setting(data):
    table = assemble(data, FEATURES, "two").persist()
    best, score, rows = training.search(SPECS["logistic"], table, [{"regParam": 1e6}, {"regParam": 0.001}], k=2)
    assert best == training.on_mean_loss({"regParam": 0.001}, table.count()) and score == max(r["score"] for r in rows)
    space = training.search_space("random_forest")
    assert training.draws(space, 3, 1) == training.draws(space, 3, 1)
    assert len(training.grid({"a": [1, 2], "b": [3, 4, 5]})) == 6


def test_macro_metrics_by_hand(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 1 + [(1, 1)] * 2 + [(2, 0)] * 2
    df = spark.createDataFrame(pairs, "label int, prediction int")
    got = evaluation.metric_values(df)
    assert got["accuracy"] == pytest.approx(0.7)
    assert got["precision_macro"] == pytest.approx((5 / 7 + 2 / 3 + 0) / 3)
    assert got["recall_macro"] == pytest.approx((5 / 6 + 1 + 0) / 3)


def test_auc_equals_pair_counting(spark):
    rng = np.random.default_rng(7)
    y, s = rng.integers(0, 2, 200), rng.integers(0, 30, 200) / 30
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)])
    assert evaluation.curve_areas(evaluation.threshold_table(df)).first()["auc"] == pytest.approx(want)


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, score double")
    assert evaluation.curve_areas(evaluation.threshold_table(df)).first()["auc"] is None


def test_donors_are_a_permutation(data):
    rows = with_donor(data.select("client_id", "a"), ["client_id"], "a", 1, 400).toPandas()
    assert sorted(rows["a"]) == sorted(rows["_donor"]) and (rows["a"] != rows["_donor"]).mean() > 0.9


def test_unused_feature_has_no_importance(data):
    table = assemble(data.withColumn("noise", F.lit(1.0)), FEATURES, "two").persist()
    model = SPECS["forest"].fit(table)
    perm = {r["feature"]: r["perm_importance"] for r in importance.permutation_importance(model, table, FEATURES, repeats=2).collect()}
    shap = {r["feature"]: r["shap_importance"] for r in importance.shapley_importance(model, table, FEATURES, draws=2).collect()}
    assert perm["noise"] == 0 and shap["noise"] == 0 and perm["a"] > perm["b"] > 0


def test_shapley_walks_add_up(data):
    """One draw: the effects of a row sum to f(row) - f(its donor)."""
    table = assemble(data, FEATURES, "two").persist()
    model = SPECS["logistic"].fit(table)
    effects = importance.shapley_values(model, table, FEATURES, draws=1, seed=42).filter("class_index = 1").groupBy("client_id").agg(F.sum("shapley").alias("s"))
    score = model.transform(table).select("client_id", F.col("scores")[1].alias("f"))
    donors = with_donor(score, ["client_id"], "f", 42, 400)
    both = effects.join(donors, "client_id").toPandas()
    assert np.allclose(both["s"], both["f"] - both["_donor"], atol=1e-9)


def test_selection_and_fallback(spark):
    table = spark.createDataFrame([("x", 0.9, None), ("y", 0.2, 0.4), ("z", None, 0.01)], "feature string, a_norm double, b_norm double")
    scored = importance.integral_score(table)
    assert [(r["feature"], r["importance_score"]) for r in scored.collect()] == [("x", 0.9), ("y", pytest.approx(0.3)), ("z", 0.01)]
    assert importance.select_features(scored, 0.05, 5) == ["x", "y"]
    assert importance.chosen_or_all([], ["x"])[0] == ["x"]


def test_projection_matches_eigenvectors(data):
    fitted = clusters.fit_projection(data, 2, FEATURES)
    x = data.select(*FEATURES).toPandas().to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    for i, w in enumerate(np.array(fitted.loadings)):
        assert abs(w @ vectors[:, -1 - i]) == pytest.approx(1.0)
        assert w[np.argmax(np.abs(w))] > 0
    out = fitted.apply(data).select("pca_component_1").toPandas()["pca_component_1"]
    assert np.allclose(out, z @ np.array(fitted.loadings[0]))


def test_clusters_are_named_by_rank(spark):
    rows = [(i, 1 + i % 2, 100 + i % 3, 1000.0 + i, 10.0) for i in range(30)] + [(50 + i, 90 + i % 2, 2 + i % 2, 5.0 + i, 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "client_id long, recency long, frequency long, monetary double, avg_purchase double")
    fitted = clusters.fit_clusters(df, k=2, starts=2)
    out = fitted.apply(df).groupBy("cluster_segment").agg(F.max("recency").alias("r"), F.count(F.lit(1)).alias("n")).collect()
    assert {(r["cluster_segment"], r["n"]) for r in out} == {("Высоколояльные", 30), ("Лояльные", 30)}
    assert {r["cluster_segment"]: r["r"] for r in out}["Высоколояльные"] == 2


@pytest.mark.parametrize("name", sorted(classifiers.BASE))
def test_search_spaces_name_existing_parameters(spark, name):
    """Every grid and range parameter is one of the learner's own, with a value it accepts."""
    spec = classifiers.base_specs()[name]
    estimator = classifiers._ESTIMATORS[spec.kind][0]
    for candidate in [*training.grid(training.search_space(name, "grid"))[:3], *training.draws(training.search_space(name), 3)]:
        estimator(**spec.with_params(**candidate).params)


def test_multiclass_query_trains_all_six_models_with_their_settings(spark, data, monkeypatch):
    """The registered query trained three of the six with a twentieth to a fiftieth of their rounds."""
    import __spark_entry__ as entry
    from checks import model_queries

    seen, plain = {}, training.train_all

    def recorded(specs, train, *args, **kwargs):
        seen.update(specs)
        short = {n: s.with_params(**({"numTrees": 2} if s.kind == "forest" else {"maxIter": 1})) for n, s in specs.items()}
        return plain(short, train, *args, **kwargs)

    monkeypatch.setattr(training, "train_all", recorded)
    monkeypatch.setattr(model_queries, "_parts", lambda *_: (table, table))
    table = assemble(data, FEATURES, "three")
    out = entry.queries()["multiclass_models"](spark, "").collect()
    assert seen == classifiers.base_specs() and len(seen) == 6
    assert {r["model"] for r in out} == set(classifiers.BASE)
