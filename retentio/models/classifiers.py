"""Classifiers with one interface over Spark ML.

``spec.fit(train)`` gives a fitted model; ``fitted.transform(df)`` adds ``scores`` (one per
class, summing to 1) and ``prediction``. Training data has ``features``, ``label``, and
optionally ``weight``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42

# Settings of the base models.
BASE = {
    "logistic_regression": ("logistic", {"maxIter": 1000}),
    "random_forest": ("forest", {"numTrees": 100, "maxDepth": 10}),
    "gradient_boosting": ("boosting", {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1}),
    "xgboost": ("boosting", {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3}),
    "lightgbm": (
        "boosting",
        {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "minInstancesPerNode": 20, "minInfoGain": 0.1},
    ),
    "svm": ("margin", {"maxIter": 100, "regParam": 0.01}),
}
_ESTIMATORS = {
    "logistic": (LogisticRegression, LogisticRegressionModel),
    "forest": (RandomForestClassifier, RandomForestClassificationModel),
    "boosting": (GBTClassifier, GBTClassificationModel),
    "margin": (LinearSVC, LinearSVCModel),
}
_SEEDED = ("forest", "boosting")
_HELPERS = ["rawPrediction", "probability", "_raw", "_p"]


def argmax(scores: Column, classes: list[int]) -> Column:
    """Class of the first largest score."""
    at = F.array_position(scores, F.array_max(scores)).cast("int")
    return F.try_element_at(F.array(*[F.lit(float(c)) for c in classes]), at)


def decide(df: DataFrame, classes: list[int]) -> DataFrame:
    return df.withColumn("prediction", argmax(F.col("scores"), classes))


def labels(df: DataFrame) -> list[int]:
    """All classes present; every one is trained, however many there are."""
    return sorted(int(row[0]) for row in df.select("label").distinct().collect())


@dataclass
class Spec:
    """A model to be trained."""

    kind: str
    params: dict = field(default_factory=dict)
    seed: int = SEED

    def with_params(self, **params) -> "Spec":
        return replace(self, params={**self.params, **params})

    def _estimator(self, df: DataFrame, label: str):
        params = dict(self.params)
        if self.kind in _SEEDED:
            params.setdefault("seed", self.seed)
        if "weight" in df.columns:
            params.setdefault("weightCol", "weight")
        return _ESTIMATORS[self.kind][0](featuresCol="features", labelCol=label, **params)

    def fit(self, df: DataFrame) -> "Fitted":
        classes = labels(df)
        if self.kind in ("logistic", "forest"):
            coded = df.withColumn("_y", _index_of(F.col("label"), classes))
            return Single(self.kind, classes, self._estimator(coded, "_y").fit(coded))
        models, platts = [], []
        for c in classes[1:] if len(classes) == 2 else classes:
            coded = df.withColumn("_y", (F.col("label") == c).cast("double"))
            model = self._estimator(coded, "_y").fit(coded)
            models.append(model)
            if self.kind == "margin":
                weight = {"weightCol": "weight"} if "weight" in df.columns else {}
                margins = _margin(model.transform(coded)).withColumn("_p", array_to_vector(F.array("_raw")))
                platts.append(LogisticRegression(featuresCol="_p", labelCol="_y", **weight).fit(margins.drop("rawPrediction", "prediction")))
        return PerClass(self.kind, classes, models, platts)


def _index_of(label: Column, classes: list[int]) -> Column:
    chain = None
    for i, c in enumerate(classes):
        chain = F.when(label == c, float(i)) if chain is None else chain.when(label == c, float(i))
    return chain


def _margin(df: DataFrame) -> DataFrame:
    return df.withColumn("_raw", vector_to_array("rawPrediction")[1])


class Fitted:
    classes: list[int]

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def importances(self) -> list[float] | None:
        return None

    def _meta(self) -> dict:
        raise NotImplementedError

    def _parts(self) -> dict:
        return {}

    def save(self, path: str) -> None:
        """Spark ML parts plus one JSON row describing how they fit together."""
        from retentio.sources.files import write_json_value

        for name, part in self._parts().items():
            part.save(f"{path}/{name}") if isinstance(part, Fitted) else part.write().overwrite().save(f"{path}/{name}")
        write_json_value(self._meta(), f"{path}/about")


@dataclass
class Single(Fitted):
    kind: str
    classes: list[int]
    model: object

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(df).withColumn("scores", vector_to_array("probability"))
        return decide(scored.drop(*_HELPERS, "prediction"), self.classes)

    def importances(self) -> list[float]:
        if self.kind == "forest":
            return [float(v) for v in self.model.featureImportances.toArray()]
        weights = abs(self.model.coefficientMatrix.toArray())
        return [float(v) for v in weights.mean(axis=0)]

    def _meta(self):
        return {"type": "single", "kind": self.kind, "classes": self.classes}

    def _parts(self):
        return {"model": self.model}


@dataclass
class PerClass(Fitted):
    """Binary models, one against the rest (a single one for two classes)."""

    kind: str
    classes: list[int]
    models: list
    platts: list

    def transform(self, df: DataFrame) -> DataFrame:
        scored, names = df, []
        for i, model in enumerate(self.models):
            scored = model.transform(scored)
            if self.platts:
                scored = _margin(scored).drop("prediction", "rawPrediction")
                scored = scored.withColumn("_p", array_to_vector(F.array("_raw")))
                scored = self.platts[i].transform(scored)
            scored = scored.withColumn(f"_score_{i}", vector_to_array("probability")[1])
            scored = scored.drop("prediction", *_HELPERS)
            names.append(f"_score_{i}")
        if len(self.classes) == 2:
            scores = F.array(1 - F.col(names[0]), F.col(names[0]))
        else:
            whole = sum([F.col(n) for n in names[1:]], F.col(names[0]))
            scores = F.array(*[F.when(whole > 0, F.col(n) / whole).otherwise(1.0 / len(names)) for n in names])
        return decide(scored.withColumn("scores", scores).drop(*names), self.classes)

    def importances(self) -> list[float]:
        if self.kind == "boosting":
            rows = [m.featureImportances.toArray() for m in self.models]
        else:
            rows = [abs(m.coefficients.toArray()) for m in self.models]
        return [float(v) for v in sum(rows) / len(rows)]

    def _meta(self):
        return {"type": "per_class", "kind": self.kind, "classes": self.classes, "n": len(self.models), "platt": bool(self.platts)}

    def _parts(self):
        parts = {f"model_{i}": m for i, m in enumerate(self.models)}
        return parts | {f"platt_{i}": m for i, m in enumerate(self.platts)}


def _member_scores(df: DataFrame, members: dict[str, Fitted]) -> tuple[DataFrame, list[str], list[str]]:
    scores, guesses = [], []
    for i, model in enumerate(members.values()):
        df = model.transform(df)
        df = df.withColumnsRenamed({"scores": f"_s{i}", "prediction": f"_g{i}"})
        scores.append(f"_s{i}")
        guesses.append(f"_g{i}")
    return df, scores, guesses


@dataclass
class Voting(Fitted):
    members: dict[str, Fitted]
    voting: str = "soft"

    @property
    def classes(self) -> list[int]:
        return next(iter(self.members.values())).classes

    def transform(self, df: DataFrame) -> DataFrame:
        scored, scores, guesses = _member_scores(df, self.members)
        n = len(scores)
        if self.voting == "soft":
            mixed = F.col(scores[0])
            for s in scores[1:]:
                mixed = F.zip_with(mixed, F.col(s), lambda a, b: a + b)
            mixed = F.transform(mixed, lambda v: v / n)
        else:
            votes = [sum([(F.col(g) == c).cast("double") for g in guesses[1:]], (F.col(guesses[0]) == c).cast("double")) / n for c in self.classes]
            mixed = F.array(*votes)
        return decide(scored.withColumn("scores", mixed).drop(*scores, *guesses), self.classes)

    def _meta(self):
        return {"type": "voting", "voting": self.voting, "members": list(self.members)}

    def _parts(self):
        return {f"member_{name}": m for name, m in self.members.items()}


@dataclass
class Stacking(Fitted):
    members: dict[str, Fitted]
    final: Fitted

    @property
    def classes(self) -> list[int]:
        return self.final.classes

    @staticmethod
    def stack(df: DataFrame, members: dict[str, Fitted]) -> DataFrame:
        """Member scores as the feature vector (one column per member for two classes)."""
        scored, scores, guesses = _member_scores(df, members)
        two = len(next(iter(members.values())).classes) == 2
        parts = [F.slice(F.col(s), 2, 1) if two else F.col(s) for s in scores]
        stacked = scored.withColumn("_original", F.col("features"))
        return stacked.withColumn("features", array_to_vector(F.concat(*parts))).drop(*scores, *guesses)

    def transform(self, df: DataFrame) -> DataFrame:
        stacked = self.final.transform(self.stack(df, self.members))
        return stacked.drop("features").withColumnRenamed("_original", "features")

    def _meta(self):
        return {"type": "stacking", "members": list(self.members)}

    def _parts(self):
        return {f"member_{name}": m for name, m in self.members.items()} | {"final": self.final}


def load(path: str) -> Fitted:
    from retentio.sources.files import read_json_value

    about = read_json_value(f"{path}/about")
    if about["type"] == "single":
        return Single(about["kind"], about["classes"], _ESTIMATORS[about["kind"]][1].load(f"{path}/model"))
    if about["type"] == "per_class":
        kind = _ESTIMATORS[about["kind"]][1]
        models = [kind.load(f"{path}/model_{i}") for i in range(about["n"])]
        platts = [LogisticRegressionModel.load(f"{path}/platt_{i}") for i in range(about["n"])] if about["platt"] else []
        return PerClass(about["kind"], about["classes"], models, platts)
    members = {name: load(f"{path}/member_{name}") for name in about["members"]}
    if about["type"] == "voting":
        return Voting(members, about["voting"])
    return Stacking(members, load(f"{path}/final"))


def base_specs(custom: dict[str, dict] | None = None, names: list[str] | None = None, rows: int | None = None) -> dict[str, Spec]:
    """The six base models, with overrides by name.

    With ``rows`` the logistic penalty equals an inverse strength of 1 on that many rows.
    """
    specs = {}
    for name, (kind, params) in BASE.items():
        if names and name not in names:
            continue
        own = dict(params)
        if name == "logistic_regression" and rows:
            own["regParam"] = 1.0 / rows
        specs[name] = Spec(kind, {**own, **(custom or {}).get(name, {})})
    return specs


def custom_spec(kind: str, **params) -> Spec:
    """Any supported learner under a name of the caller's choice."""
    if kind not in _ESTIMATORS:
        raise ValueError(f"unknown learner {kind}; known: {', '.join(_ESTIMATORS)}")
    return Spec(kind, params)


def describe(spec: Spec) -> str:
    return json.dumps({"kind": spec.kind, **spec.params}, sort_keys=True)
