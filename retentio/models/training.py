"""Training of several models, ensembles, cross-validation, and parameter search."""

from __future__ import annotations

import itertools
import json
import math
import random
import time
from concurrent.futures import ThreadPoolExecutor
from statistics import fmean, pstdev, stdev

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.models.classifiers import Fitted, Spec, Stacking, Voting, custom_spec
from retentio.operators.evaluation import METRICS, confusion, metric_values, metrics
from retentio.operators.sampling import folds, split, time_folds


def train_all(specs: dict[str, Spec], train: DataFrame, parallelism: int = 2) -> tuple[dict[str, Fitted], dict[str, float]]:
    """Fit every model; jobs of different models share the cluster through driver threads."""
    seconds: dict[str, float] = {}

    def run(item):
        name, spec = item
        start = time.time()
        fitted = spec.fit(train)
        seconds[name] = time.time() - start
        return name, fitted

    with ThreadPoolExecutor(parallelism) as pool:
        models = dict(pool.map(run, specs.items()))
    return {name: models[name] for name in specs}, seconds


def predict_all(models: dict[str, Fitted], df: DataFrame, keep: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """Long predictions: (model, kept columns, label, scores, prediction)."""
    parts = [
        m.transform(df).select(F.lit(name).alias("model"), *[k for k in keep if k in df.columns], "label", "scores", "prediction")
        for name, m in models.items()
    ]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def evaluate_all(models: dict[str, Fitted], df: DataFrame, seconds: dict[str, float] | None = None) -> DataFrame:
    counts = confusion(predict_all(models, df), keys=["model"])
    table = metrics(counts, ["model"])
    if seconds:
        chain = F.lit(None).cast("double")
        for name, s in seconds.items():
            chain = F.when(F.col("model") == name, F.lit(float(s))).otherwise(chain)
        table = table.withColumn("train_seconds", chain)
    return table


def voting_ensemble(specs: dict[str, Spec], train: DataFrame, voting: str = "soft") -> Voting:
    return Voting(train_all(specs, train)[0], voting)


def stacking_ensemble(specs: dict[str, Spec], train: DataFrame, final: Spec | None = None, k: int = 5) -> Stacking:
    """Members predict rows they have not seen; the final model learns from those scores."""
    folded = folds(train, "label", k)
    unseen = None
    for i in range(k):
        members, _ = train_all(specs, folded.filter(F.col("fold") != i))
        part = Stacking.stack(folded.filter(F.col("fold") == i), members).drop("fold", "_original")
        unseen = part if unseen is None else unseen.unionByName(part)
    final_model = (final or custom_spec("logistic", maxIter=1000)).fit(unseen)
    return Stacking(train_all(specs, train)[0], final_model)


def _fold_rows(spec: Spec, parts, parallelism: int) -> list[dict]:
    """Scores of one model on (name, train, test) parts."""

    def run(part):
        name, train, test = part
        start = time.time()
        model = spec.fit(train)
        seconds = time.time() - start
        row = {"part": name, "fit_seconds": seconds}
        for side, data in (("train", train), ("test", test)):
            values = metric_values(model.transform(data))
            row |= {f"{side}_{m}": values[m] for m in METRICS}
        return row

    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(run, parts))


def summarise(rows: list[dict], method: str, model: str = "model") -> list[dict]:
    """Mean and population deviation per metric over the folds."""
    out = []
    for m in METRICS:
        test, train = [r[f"test_{m}"] for r in rows], [r[f"train_{m}"] for r in rows]
        mean, sd = fmean(test), pstdev(test)
        out.append(
            {
                "model": model, "method": method, "metric": m, "train_mean": fmean(train), "train_std": pstdev(train),
                "test_mean": mean, "test_std": sd, "cv_percent": sd / mean * 100 if mean else None,
                "fit_seconds": fmean([r["fit_seconds"] for r in rows]),
            }
        )
    return out


def cross_validate(spec: Spec, df: DataFrame, k: int = 5, stratified: bool = True, seed: int = 42, parallelism: int = 2) -> list[dict]:
    folded = folds(df, "label" if stratified else None, k, seed)
    parts = [(i, folded.filter(F.col("fold") != i), folded.filter(F.col("fold") == i)) for i in range(k)]
    return _fold_rows(spec, parts, parallelism)


def time_cross_validate(spec: Spec, df: DataFrame, time_column: str, k: int = 5, parallelism: int = 2) -> list[dict]:
    """Expanding window: every block is predicted from all earlier blocks."""
    blocked = time_folds(df, time_column, k)
    parts = [(i, blocked.filter(F.col("block") < i), blocked.filter(F.col("block") == i)) for i in range(1, k + 1)]
    return _fold_rows(spec, parts, parallelism)


def stability(spec: Spec, df: DataFrame, runs: int = 10, test_share: float = 0.2, seed: int = 42, stratified: bool = True, parallelism: int = 2) -> list[dict]:
    parts = []
    for i in range(runs):
        cut = split(df, "label" if stratified else None, test_share, seed + i)
        parts.append((i + 1, cut.filter("split = 'train'"), cut.filter("split = 'test'")))
    return _fold_rows(spec, parts, parallelism)


def stability_summary(rows: list[dict], model: str = "model") -> list[dict]:
    """Mean, sample deviation, extremes, range, and relative deviation per metric."""
    out = []
    for m in METRICS:
        values = [r[f"test_{m}"] for r in rows]
        mean, sd = fmean(values), stdev(values) if len(values) > 1 else 0.0
        out.append(
            {
                "model": model, "metric": m, "mean": mean, "std": sd, "min": min(values), "max": max(values),
                "range": max(values) - min(values), "cv": sd / mean if mean else None,
            }
        )
    return out


def compare_validation(spec: Spec, df: DataFrame, time_column: str, k: int = 5, runs: int = 10, model: str = "model") -> DataFrame:
    """(metric, method) table of score, deviation, and relative deviation."""
    spark = df.sparkSession
    rows = summarise(cross_validate(spec, df, k), "stratified", model)
    rows += summarise(time_cross_validate(spec, df, time_column, k), "time", model)
    for r in stability_summary(stability(spec, df, runs), model):
        rows.append(
            {
                "model": model, "method": "stability", "metric": r["metric"], "test_mean": r["mean"],
                "test_std": r["std"], "cv_percent": r["cv"] * 100 if r["cv"] is not None else None,
            }
        )
    return spark.createDataFrame(
        [(r["model"], r["method"], r["metric"], r.get("train_mean"), r["test_mean"], r["test_std"], r["cv_percent"]) for r in rows],
        "model string, method string, metric string, train_score double, test_score double, std double, cv_percent double",
    )


def pivot_validation(comparison: DataFrame) -> DataFrame:
    methods = ["stratified", "time", "stability"]
    return comparison.groupBy("metric").pivot("method", methods).agg(
        F.avg("test_score").alias("score"), F.avg("std").alias("std"), F.avg("cv_percent").alias("cv_percent")
    )


# Search ranges, limited to parameters Spark ML has. Penalties are for a loss summed
# over the rows, as the ranges were given; ``on_mean_loss`` turns them into Spark's.
GRIDS = {
    "logistic_regression": {"regParam": [10.0, 1.0, 0.1, 0.01, 0.001], "elasticNetParam": [0.0, 1.0]},
    "random_forest": {
        "numTrees": [50, 100, 200], "maxDepth": [5, 10, 20], "minInstancesPerNode": [1, 2, 4],
        "featureSubsetStrategy": ["sqrt", "log2", "all"],
    },
    "gradient_boosting": {
        "maxIter": [50, 100, 200], "stepSize": [0.01, 0.05, 0.1, 0.2], "maxDepth": [3, 5, 7],
        "subsamplingRate": [0.7, 0.8, 0.9, 1.0],
    },
    "xgboost": {
        "maxIter": [50, 100, 200], "stepSize": [0.01, 0.05, 0.1, 0.2], "maxDepth": [3, 5, 7],
        "minInstancesPerNode": [1, 3, 5], "subsamplingRate": [0.7, 0.8, 0.9],
    },
    "lightgbm": {
        "maxIter": [50, 100, 200], "stepSize": [0.01, 0.05, 0.1], "maxDepth": [3, 5, 7],
        "subsamplingRate": [0.7, 0.8, 0.9], "minInstancesPerNode": [5, 10, 20],
    },
    "svm": {"regParam": [10.0, 1.0, 0.1, 0.01]},
}
# (low, high, scale): inclusive ranges for seeded draws.
RANGES = {
    "logistic_regression": {"regParam": (1e-4, 1e4, "log"), "elasticNetParam": (0.0, 1.0, "real")},
    "random_forest": {
        "numTrees": (50, 500, "int"), "maxDepth": (3, 30, "int"), "minInstancesPerNode": (1, 30, "int"),
        "impurity": ["gini", "entropy"],
    },
    "gradient_boosting": {"maxIter": (50, 200, "int"), "stepSize": (0.001, 0.3, "log"), "maxDepth": (3, 12, "int")},
    "xgboost": {
        "maxIter": (50, 1000, "int"), "stepSize": (0.001, 0.3, "log"), "maxDepth": (3, 15, "int"),
        "subsamplingRate": (0.5, 1.0, "real"),
    },
    "lightgbm": {
        "maxIter": (50, 1000, "int"), "stepSize": (0.001, 0.3, "log"), "maxDepth": (3, 15, "int"),
        "subsamplingRate": (0.5, 1.0, "real"), "minInstancesPerNode": (5, 100, "int"),
    },
    "svm": {"regParam": (1e-3, 100.0, "log")},
}


def search_space(model: str, search: str = "random") -> dict:
    """Ranges of a model: ``grid`` lists values, ``random`` and ``bayesian`` give ranges."""
    return (GRIDS if search == "grid" else RANGES).get(model, {})


def grid(space: dict) -> list[dict]:
    names = list(space)
    return [dict(zip(names, values)) for values in itertools.product(*space.values())]


def draws(space: dict, n: int, seed: int = 42) -> list[dict]:
    """Seeded parameter draws from lists and (low, high, scale) ranges."""
    rng = random.Random(seed)

    def one(choice):
        if isinstance(choice, list):
            return rng.choice(choice)
        low, high, scale = choice
        if scale == "int":
            return rng.randint(low, high)
        if scale == "log":
            return math.exp(rng.uniform(math.log(low), math.log(high)))
        return rng.uniform(low, high)

    return [{name: one(choice) for name, choice in space.items()} for _ in range(n)]


def on_mean_loss(params: dict, rows: float) -> dict:
    """Spark's penalty belongs to the mean loss: a penalty on the summed loss is divided by the rows."""
    return {name: value / max(rows, 1) if name == "regParam" else value for name, value in params.items()}


def search(spec: Spec, df: DataFrame, candidates: list[dict], k: int = 5, metric: str = "f1_macro", seed: int = 42, parallelism: int = 2) -> tuple[dict, float, list[dict]]:
    """Mean stratified cross-validation score of every candidate; the first best one wins.

    The winner comes back ready to fit on all rows; the table keeps candidates as given.
    """
    n = df.count()
    folded = folds(df, "label", k, seed)
    parts = [(folded.filter(F.col("fold") != i), folded.filter(F.col("fold") == i)) for i in range(k)]

    def run(job):
        c, i = job
        model = spec.with_params(**on_mean_loss(candidates[c], n * (k - 1) / k)).fit(parts[i][0])
        return c, metric_values(model.transform(parts[i][1]))[metric]

    jobs = [(c, i) for c in range(len(candidates)) for i in range(k)]
    with ThreadPoolExecutor(parallelism) as pool:
        scores = list(pool.map(run, jobs))
    rows = []
    for c, params in enumerate(candidates):
        values = [s for j, s in scores if j == c]
        rows.append({"params": params, "score": fmean(values), "std": pstdev(values)})
    best = max(rows, key=lambda r: r["score"])
    return on_mean_loss(best["params"], n), best["score"], rows


def search_table(spark: SparkSession, model: str, rows: list[dict]) -> DataFrame:
    """Ranked configurations, best first."""
    ranked = sorted(rows, key=lambda r: -r["score"])
    return spark.createDataFrame(
        [(model, i + 1, json.dumps(r["params"], sort_keys=True), float(r["score"]), float(r["std"])) for i, r in enumerate(ranked)],
        "model string, rank int, params string, score double, std double",
    )


def score_by_parameter(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Mean and spread of the score at every value of every parameter."""
    long = [(name, str(value), float(r["score"])) for r in rows for name, value in r["params"].items()]
    df = spark.createDataFrame(long, "parameter string, value string, score double")
    return df.groupBy("parameter", "value").agg(
        F.avg("score").alias("mean_score"), F.max("score").alias("best_score"), F.count(F.lit(1)).alias("n")
    )


def tune_models(specs: dict[str, Spec], df: DataFrame, method: str = "random", n: int = 20, k: int = 5, seed: int = 42) -> tuple[dict[str, Spec], DataFrame]:
    """Search every model; returns the specs with their best settings and a comparison table."""
    tuned, rows = {}, []
    for name, spec in specs.items():
        space = search_space(name, method)
        candidates = grid(space) if method == "grid" else draws(space, n, seed)
        best, score, _ = search(spec, df, candidates, k, seed=seed)
        tuned[name] = spec.with_params(**best)
        rows.append((name, float(score), json.dumps(best, sort_keys=True)))
    table = df.sparkSession.createDataFrame(rows, "model string, best_score double, best_params string")
    return tuned, table.orderBy(F.desc("best_score"), "model")


