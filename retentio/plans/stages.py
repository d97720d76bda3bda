"""The stages from raw purchases to loyalty categories and model data.

Every stage is fit (a few small jobs) plus apply (expressions), so training and scoring run
the same code. Stage tables are written so that later passes read columns, not lineage.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.functions.columns import has
from retentio.models.classifiers import Spec, custom_spec
from retentio.operators import categories, sampling
from retentio.operators.clusters import Clustering, Projection, Standardiser, fit_clusters, fit_projection
from retentio.operators.customers import aggregate_customers
from retentio.operators.encode import CLOTHING_RULES, Encoder, apply_encoder, fit_encoder
from retentio.operators.importance import chosen_or_all, evaluate_features, select_features
from retentio.operators.impute import Imputer, fill_means, fit_imputer
from retentio.operators.loyalty import add_features, add_score
from retentio.operators.rfm import prepare_customers, two_pass_rfm
from retentio.operators.scaling import Fences, Scaler, fit_fences, fit_scaler, winsorise
from retentio.session import materialize


@dataclass
class Cleaning:
    """Everything fitted on transactions."""

    imputer: Imputer
    fences: dict[str, Fences]
    scaler: Scaler | None
    encoder: Encoder

    def apply(self, transactions: DataFrame) -> DataFrame:
        # staged as in training, so that sums over served rows add up in the same parts
        cut = winsorise(self.imputer.apply_staged(transactions), self.fences)
        return apply_encoder(self.scaler.apply(cut) if self.scaler else cut, self.encoder)


def fit_cleaning(transactions: DataFrame, product_rules=CLOTHING_RULES, scale: bool = True) -> Cleaning:
    """Impute, winsorise, scale, encode; each fit sees the output of the step before.

    ``transactions`` should be a written table. Its rows with a gap that a median fills are
    written once more, filled: the three later fits and the aggregation read both, and none of
    them touches the medians join again.
    """
    imputer = fit_imputer(transactions)
    filled = imputer.apply_staged(transactions)
    fences = fit_fences(filled)
    cut = winsorise(filled, fences)
    scaler = fit_scaler(cut) if scale else None
    encoder = fit_encoder(cut, product_rules=product_rules)
    fitted = Cleaning(imputer, fences, scaler, encoder)
    fitted.filled = filled
    return fitted


def cleaned(fitted: Cleaning) -> DataFrame:
    """The fitted transactions themselves, starting from the written filled table."""
    cut = winsorise(fitted.filled, fitted.fences)
    return apply_encoder(fitted.scaler.apply(cut) if fitted.scaler else cut, fitted.encoder)


@dataclass
class Loyalty:
    """Everything fitted on customers."""

    clustering: Clustering
    projection: Projection
    boundaries: list[float]
    target: dict[str, int]
    parity: bool = True
    base_scale: str = "raw"

    def apply(self, customers: DataFrame) -> DataFrame:
        """From scored customers (R, F, M present or not) to categories and target."""
        clustered = self.clustering.apply(add_features(customers, self.parity))
        scored = add_score(self.projection.apply(clustered), self.base_scale)
        return sampling.add_target(categories.categorise(scored, self.boundaries), self.target)


def fit_loyalty(
    customers: DataFrame, clusters: int | str = 5, starts: int = 10, components: int = 3, parity: bool = True,
    base_scale: str = "raw", method: str = "quantile", custom: list[float] | None = None, seed: int = 42, max_iter: int = 20,
) -> tuple[DataFrame, Loyalty]:
    """Features, clusters, components, score, categories, target."""
    featured = materialize(add_features(customers, parity), "featured")
    clustering = fit_clusters(featured, clusters, seed, starts, max_iter)
    clustered = clustering.apply(featured)
    projection = fit_projection(clustered, components)
    scored = materialize(add_score(projection.apply(clustered), base_scale), "scored")
    boundaries = categories.fit_boundaries(scored, method, 5, custom)
    categorised = categories.categorise(scored, boundaries)
    target = sampling.fit_target(categorised)
    return sampling.add_target(categorised, target), Loyalty(clustering, projection, boundaries, target, parity, base_scale)


@dataclass
class ModelData:
    table: DataFrame  # client_id, features..., label, split, features vector
    features: list[str]
    names: dict[int, str]
    importance: DataFrame | None
    about: dict = field(default_factory=dict)

    def part(self, name: str) -> DataFrame:
        return self.table.filter(F.col("split") == name)


def assemble(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    """Add the feature vector (and ``label``) that the models read."""
    numbers = df.withColumns({f: F.col(f).cast("double") for f in features})
    if label is not None:
        numbers = numbers.withColumn("label", F.col(label).cast("double"))
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(numbers)


def prepare_model_data(
    loyalty: DataFrame, target: dict[str, int], balance: str = "none", selection: bool = True, minimum: float = 0.05,
    at_most: int = 30, test_share: float = 0.2, seed: int = 42, forest: Spec | None = None,
    methods: tuple[str, ...] = ("correlation", "model_based", "permutation", "shap"), repeats: int = 10, draws: int = 4,
) -> ModelData:
    """Balance, rank and select features, split with exact class shares."""
    balanced, label, recut = sampling.rebalance(loyalty, balance, seed=seed)
    names = sampling.class_names(recut or target)
    features = sampling.model_features(balanced, label)
    keep = [c for c in ("client_id", "is_synthetic", "last_ts") if has(balanced, c)]
    numbers = fill_means(balanced.filter(F.col(label).isNotNull()), features).select(*keep, label, *features)
    if "is_synthetic" in numbers.columns:
        numbers = numbers.withColumn("_row", F.monotonically_increasing_id())
    numbers = materialize(numbers, "model-data")
    ids = ("_row",) if "_row" in numbers.columns else ("client_id",)
    importance, note = None, None
    if selection:
        halves = materialize(
            sampling.split(assemble(numbers, features, label), None, 0.3, seed, ids), "importance-split"
        )
        train, test = halves.filter("split = 'train'"), halves.filter("split = 'test'")
        model = (forest or custom_spec("forest", numTrees=100, maxDepth=10)).fit(train)
        importance = materialize(
            evaluate_features(halves, features, "label", model, test, methods, repeats, draws, seed, ids),
            "importance",
        )
        picked = select_features(importance, minimum, at_most, "score", features)
        features, note = chosen_or_all(picked, features)
    table = materialize(sampling.split(assemble(numbers, features, label), "label", test_share, seed, ids), "model-data")
    counts = {part: sampling.class_counts(table.filter(F.col("split") == part), "label") for part in ("train", "test")}
    about = {
        "feature_count": len(features),
        "feature_list": features,
        "target_column": label,
        "train_size": sum(counts["train"].values()),
        "test_size": sum(counts["test"].values()),
        "train_distribution": {str(int(k)): v for k, v in counts["train"].items()},
        "test_distribution": {str(int(k)): v for k, v in counts["test"].items()},
        "balance_method": balance,
        "feature_selection": selection,
        "min_importance": minimum,
        "max_features": at_most,
        "train_test_split_ratio": test_share,
        "random_state": seed,
        "note": note,
    }
    return ModelData(table, features, names, importance, about)


def customers_from(fitted: Cleaning) -> DataFrame:
    return aggregate_customers(cleaned(fitted))


def rfm_customers(customers: DataFrame, passes: int = 2) -> DataFrame:
    return two_pass_rfm(customers) if passes == 2 else prepare_customers(customers)


def loyalty_as_dict(fitted: Loyalty) -> dict:
    return asdict(fitted)


def loyalty_from_dict(value: dict) -> Loyalty:
    clustering = value["clustering"]
    projection = value["projection"]
    return Loyalty(
        Clustering(
            Standardiser(**clustering["standardiser"]),
            clustering["centres"],
            {int(k): v for k, v in clustering["segments"].items()},
        ),
        Projection(Standardiser(**projection["standardiser"]), projection["loadings"], projection["explained"], projection["components"]),
        value["boundaries"],
        value["target"],
        value["parity"],
        value["base_scale"],
    )
