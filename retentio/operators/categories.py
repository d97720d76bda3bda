"""Score categories: boundaries, assignment, evaluation, profiles, comparisons."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentio.functions.columns import has, numeric_columns
from retentio.operators.quantiles import exact_quantiles, rank_values

SCORE = "loyalty_score"
CATEGORY = "loyalty_category"

# Category names from lowest to highest score, and profile metrics.
NAMES = ["Отток", "Низколояльные", "Умеренно лояльные", "Лояльные", "Высоколояльные"]
PROFILE_METRICS = [
    "recency",
    "frequency",
    "monetary",
    "avg_purchase",
    "bonus_usage_ratio",
    "bonus_earning_ratio",
    "bonus_activity",
    "recency_ratio",
    "purchase_density",
    "activity_period",
    "product_diversity",
    "product_gini",
    "purchase_stability",
    "location_loyalty",
]


def category_names(n: int) -> list[str]:
    return NAMES if n == 5 else [f"Категория {i + 1}" for i in range(n)]


def fit_boundaries(
    df: DataFrame, method: str = "quantile", n: int = 5, custom: list[float] | None = None, score: str = SCORE
) -> list[float]:
    """n + 1 boundaries from 0 to 1; equal neighbours are allowed."""
    if method == "quantile":
        return [0.0, *exact_quantiles(df, [score], [i / n for i in range(1, n)])[score], 1.0]
    if method == "kmeans":
        points = VectorAssembler(inputCols=[score], outputCol="_x").transform(df.select(score).dropna())
        centres = KMeans(k=n, seed=42, featuresCol="_x").fit(points).clusterCenters()
        ordered = sorted(float(c[0]) for c in centres)
        return [0.0, *[(a + b) / 2 for a, b in zip(ordered, ordered[1:])], 1.0]
    if method == "equal_width":
        return [i * (1.0 / n) for i in range(n + 1)]
    if method == "manual":
        if custom is None or len(custom) != n + 1:
            raise ValueError(f"manual categories need {n + 1} boundaries")
        return [float(b) for b in custom]
    raise ValueError(f"unknown method {method}")


def category_expression(score: Column, boundaries: list[float]) -> Column:
    """First i with b[i] <= score < b[i+1], else the last category."""
    names = category_names(len(boundaries) - 1)
    chain = None
    for low, high, name in zip(boundaries, boundaries[1:], names):
        if low >= high:
            continue  # an empty interval catches nothing
        hit = (score >= low) & (score < high)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return F.lit(names[-1]) if chain is None else chain.otherwise(names[-1])


def categorise(df: DataFrame, boundaries: list[float], score: str = SCORE, category: str = CATEGORY) -> DataFrame:
    return df.withColumn(category, category_expression(F.col(score), boundaries))


def evaluate_distribution(df: DataFrame, category: str = CATEGORY) -> DataFrame:
    """Balance of the categories: imbalance, entropy in bits, and its share of the maximum."""
    counts = df.filter(F.col(category).isNotNull()).groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    summed = counts.agg(
        F.sum("n").alias("clients"),
        F.count(F.lit(1)).alias("categories"),
        (F.max("n") / F.min("n")).alias("imbalance"),
        F.sum(F.col("n") * F.log2("n")).alias("_nlogn"),
    )
    entropy = F.log2("clients") - F.col("_nlogn") / F.col("clients")
    share = F.when(F.col("categories") > 1, F.col("entropy") / F.log2("categories")).otherwise(F.lit(0.0))
    return (
        summed.withColumn("entropy", entropy)
        .withColumn("normalized_entropy", share)
        .withColumn("is_balanced", F.col("normalized_entropy") > 0.8)
        .drop("_nlogn")
    )


def category_counts(df: DataFrame, category: str = CATEGORY) -> DataFrame:
    """Count and percentage per category; the window runs over the few category rows."""
    counts = df.filter(F.col(category).isNotNull()).groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(whole))


def category_profiles(df: DataFrame, category: str = CATEGORY, metrics: list[str] | None = None) -> DataFrame:
    """Mean key metrics, size and share per category."""
    metrics = metrics or [m for m in PROFILE_METRICS if has(df, m)] or numeric_columns(df)
    profile = (
        df.filter(F.col(category).isNotNull())
        .groupBy(category)
        .agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("size"))
    )
    whole = Window.partitionBy(F.lit(0))
    return profile.withColumn("share", F.col("size") / F.sum("size").over(whole))


def optimise_boundaries(df: DataFrame, shares: list[float], score: str = SCORE) -> list[float]:
    """Boundaries whose categories hold the given percentages, rounded to two digits."""
    if abs(sum(shares) - 100) > 1e-9:
        raise ValueError("category shares have to sum to 100")
    reached, cumulative = [], 0.0
    for share in shares[:-1]:
        cumulative += share
        reached.append(cumulative)

    def positions(n: int) -> list[int]:
        return [int(n * c / 100) for c in reached]

    sizes: dict[str, int] = {}
    values = rank_values(df, {score: (F.col(score), positions)}, sizes)[score]
    picked = [values[p] for p in positions(sizes[score])]
    return [0.0, *[round(float(v), 2) if v is not None else 1.0 for v in picked], 1.0]


def agreement(df: DataFrame, a: str = CATEGORY, b: str = "loyalty_segment") -> DataFrame:
    same = F.coalesce((F.col(a) == F.col(b)).cast("double"), F.lit(0.0))
    return df.agg((F.avg(same) * 100).alias("percent"))


def transition_matrix(
    base: DataFrame, enhanced: DataFrame, key: str = "client_id", a: str = "loyalty_segment", b: str = CATEGORY
) -> DataFrame:
    """Share of each base segment that lands in each category, customers matched by key.

    The columns are the five names, or the categories that occur where there are others.
    """
    found = sorted(row[0] for row in enhanced.select(b).filter(F.col(b).isNotNull()).distinct().collect())
    names = NAMES if set(found) <= set(NAMES) else found
    matched = base.select(key, a).join(enhanced.select(key, b).filter(F.col(b).isNotNull()), key)
    counts = matched.groupBy(a).pivot(b, names).count()
    filled = {n: F.coalesce(F.col(f"`{n}`"), F.lit(0)) for n in names}
    whole = sum(list(filled.values())[1:], filled[names[0]])
    return counts.select(a, *[(c / whole).alias(n) for n, c in filled.items()])


def normalised_profiles(df: DataFrame, category: str = CATEGORY, metrics: list[str] | None = None) -> DataFrame:
    """Category means rescaled to [0, 1] across categories, long form, at most 8 metrics."""
    metrics = (metrics or [m for m in PROFILE_METRICS if has(df, m)])[:8]
    profile = df.groupBy(category).agg(*[F.avg(m).cast("double").alias(m) for m in metrics])
    long = profile.unpivot([category], metrics, "metric", "mean")
    per_metric = Window.partitionBy("metric")
    low, high = F.min("mean").over(per_metric), F.max("mean").over(per_metric)
    scaled = F.when(high > low, (F.col("mean") - low) / (high - low)).otherwise(F.lit(0.0))
    return long.select(category, "metric", "mean", scaled.alias("scaled"))


def before_after_counts(before: DataFrame, after: DataFrame, a: str, b: str) -> DataFrame:
    """Class sizes of two tables side by side."""
    left = before.groupBy(F.col(a).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("before"))
    right = after.groupBy(F.col(b).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("after"))
    joined = left.join(right, "class", "full_outer")
    return joined.select("class", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("before", "after")])
