"""Customer clusters and principal components on standardised features."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions.columns import total

NOT_FEATURES = {"client_id", "rfm_score", "rfm_group", "loyalty_segment", "R", "F", "M"}
NOT_FEATURES |= {"cluster", "cluster_segment", "loyalty_score", "base_loyalty_score", "loyalty_target"}

# Segment names by rank.
CLUSTER_NAMES = ["Высоколояльные", "Лояльные", "Умеренно лояльные", "Низколояльные", "Отток"]


def feature_columns(df: DataFrame) -> list[str]:
    """Long and double columns that are not keys, scores, or earlier results."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.LongType, T.DoubleType))
        and f.name not in NOT_FEATURES
        and not f.name.startswith("pca_component_")
    ]


@dataclass
class Standardiser:
    """Mean fill and population standardisation of a fixed feature list."""

    columns: list[str]
    means: dict[str, float]
    deviations: dict[str, float]

    def values(self) -> list[Column]:
        out = []
        for c in self.columns:
            if self.deviations[c]:
                x = F.coalesce(F.col(c).cast("double"), F.lit(self.means[c]))
                out.append((x - F.lit(self.means[c])) / F.lit(self.deviations[c]))
            else:
                out.append(F.lit(0.0))
        return out

    def vector(self) -> Column:
        return array_to_vector(F.array(*self.values()))


def fit_standardiser(df: DataFrame, columns: list[str] | None = None) -> Standardiser:
    columns = columns or feature_columns(df)
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    means = {c: row[f"m{i}"] or 0.0 for i, c in enumerate(columns)}
    spread = {c: row[f"s{i}"] or 0.0 for i, c in enumerate(columns)}
    return Standardiser(columns, means, spread)


def fit_kmeans(points: DataFrame, k: int, seed: int = 42, starts: int = 10, parallelism: int = 2, max_iter: int = 300) -> KMeansModel:
    """Best of several starts by within-cluster cost."""

    def run(i: int) -> KMeansModel:
        return KMeans(k=k, seed=seed + i, maxIter=max_iter, featuresCol="_x", predictionCol="cluster").fit(points)

    with ThreadPoolExecutor(parallelism) as pool:
        models = list(pool.map(run, range(starts)))
    return min(models, key=lambda m: m.summary.trainingCost)


def choose_k(points: DataFrame, ks=range(2, 11), seed: int = 42, starts: int = 10, parallelism: int = 2) -> tuple[int, dict[int, float]]:
    """k with the best mean silhouette (squared Euclidean, linear in the rows)."""
    silhouette = ClusteringEvaluator(featuresCol="_x", predictionCol="cluster")

    def run(k: int) -> float:
        return silhouette.evaluate(fit_kmeans(points, k, seed, starts).transform(points))

    with ThreadPoolExecutor(parallelism) as pool:
        scores = dict(zip(ks, pool.map(run, ks)))
    return max(scores, key=scores.get), scores


@dataclass
class Clustering:
    standardiser: Standardiser
    centres: list[list[float]]
    segments: dict[int, str]

    def cluster(self) -> Column:
        """Nearest centre as an expression: no model object is needed to score rows."""
        z = F.array(*self.standardiser.values())
        distances = [
            F.aggregate(
                F.zip_with(z, F.array(*[F.lit(float(v)) for v in centre]), lambda a, b: (a - b) * (a - b)),
                F.lit(0.0),
                lambda s, v: s + v,
            )
            for centre in self.centres
        ]
        nearest = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(distances)]))
        return nearest["i"]

    def apply(self, df: DataFrame) -> DataFrame:
        labelled = df.withColumn("cluster", self.cluster())
        chain = None
        for i, name in self.segments.items():
            hit = F.col("cluster") == i
            chain = F.when(hit, name) if chain is None else chain.when(hit, name)
        return labelled.withColumn("cluster_segment", chain)


def cluster_profile(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    metrics = [m for m in ("recency", "frequency", "monetary", "avg_purchase") if m in df.columns]
    return df.groupBy(cluster).agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n"))


def _average_rank(order: Column, value: str) -> Column:
    """Rank with ties averaged; used on one row per cluster."""
    whole = Window.partitionBy(F.lit(0))
    return F.rank().over(whole.orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(value)) - 1) / 2


def rank_clusters(profile: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Clusters from most to least loyal: recent, frequent, and high-spending first."""
    ranked = (
        profile.withColumn("recency_rank", _average_rank(F.asc("recency"), "recency"))
        .withColumn("frequency_rank", _average_rank(F.desc("frequency"), "frequency"))
        .withColumn("monetary_rank", _average_rank(F.desc("monetary"), "monetary"))
        .withColumn("total_rank", F.col("recency_rank") + F.col("frequency_rank") + F.col("monetary_rank"))
    )
    order = Window.partitionBy(F.lit(0)).orderBy("total_rank", cluster)
    position = F.row_number().over(order)
    names = F.array(*[F.lit(n) for n in CLUSTER_NAMES])
    name = F.when(position <= len(CLUSTER_NAMES), F.try_element_at(names, position))
    segment = F.coalesce(name, F.concat(F.lit("Сегмент "), position.cast("string")))
    return ranked.withColumn("position", position).withColumn("cluster_segment", segment)


def fit_clusters(df: DataFrame, k: int | str = 5, seed: int = 42, starts: int = 10, max_iter: int = 300) -> Clustering:
    standardiser = fit_standardiser(df)
    # not persisted here: each fit keeps its own vectors, ready to use, where a cached table
    # would be decoded again in every iteration
    points = df.select(standardiser.vector().alias("_x"))
    if k == "auto":
        k = choose_k(points, seed=seed, starts=starts)[0]
    centres = [[float(v) for v in c] for c in fit_kmeans(points, k, seed, starts, max_iter=max_iter).clusterCenters()]
    fitted = Clustering(standardiser, centres, {})
    labelled = df.withColumn("cluster", fitted.cluster())
    ranked = rank_clusters(cluster_profile(labelled)).select("cluster", "cluster_segment").collect()
    fitted.segments = {row["cluster"]: row["cluster_segment"] for row in ranked}
    return fitted


@dataclass
class Projection:
    standardiser: Standardiser
    loadings: list[list[float]]  # one list per component
    explained: list[float]
    components: int

    def apply(self, df: DataFrame) -> DataFrame:
        z = self.standardiser.values()
        added = {}
        for i in range(self.components):
            if i < len(self.loadings):
                terms = [x * F.lit(w) for x, w in zip(z, self.loadings[i])]
                added[f"pca_component_{i + 1}"] = total(terms)
            else:
                added[f"pca_component_{i + 1}"] = F.lit(0.0)
        return df.withColumns(added)


def fit_projection(df: DataFrame, components: int = 3, columns: list[str] | None = None) -> Projection:
    """Principal components; the largest loading of each is positive, so signs are stable."""
    standardiser = fit_standardiser(df, columns)
    k = min(components, len(standardiser.columns))
    if k == 0:
        return Projection(standardiser, [], [], components)
    points = df.select(standardiser.vector().alias("_x"))
    model = PCA(k=k, inputCol="_x", outputCol="_p").fit(points)
    loadings = []
    for column in model.pc.toArray().T:
        sign = 1.0 if column[int(np.argmax(np.abs(column)))] >= 0 else -1.0
        loadings.append([float(v * sign) for v in column])
    return Projection(standardiser, loadings, [float(v) for v in model.explainedVariance], components)

