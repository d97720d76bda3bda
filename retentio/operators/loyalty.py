"""Engineered loyalty features and the composite loyalty score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.functions.columns import clip, has, ratio, total

# Weights of the RFM mix and of the score terms.
RFM_WEIGHTS = {"R": 0.5, "F": 0.3, "M": 0.2}
BASE_WEIGHT = 0.7
BONUS_WEIGHTS = {
    "bonus_usage_ratio": 0.15,
    "product_gini": 0.10,
    "purchase_stability": 0.15,
    "location_loyalty": 0.10,
    "recency_ratio": -0.20,
}
CLIPPED_TERMS = ("bonus_usage_ratio", "recency_ratio")


def _shares(df: DataFrame, prefix: str) -> list[str]:
    engineered = {"product_category", "product_name", "product_diversity", "product_gini"}
    engineered |= {"location_loyalty", "location_diversity"}
    return [c for c in df.columns if c.startswith(prefix) and c not in engineered]


def gini_simpson(columns: list[str], purchases: str | None = None) -> Column:
    """1 - sum of squared shares; 0 when there is nothing to share.

    With the number of purchases, shares that are whole counts of it are turned back into
    counts, so that the result does not depend on the order of floating-point sums.
    """
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]

    def form(parts: list[Column]) -> Column:
        whole, squares = total(parts), total([v * v for v in parts])
        return F.when(whole == 0, F.lit(0.0)).otherwise((whole * whole - squares) / (whole * whole))

    if purchases is None:
        return form(values)
    exact = [v * F.col(purchases) for v in values]
    counts = [F.round(v) for v in exact]
    off = reduce(F.greatest, [F.abs(v - k) for v, k in zip(exact, counts)]) if len(exact) > 1 else F.abs(exact[0] - counts[0])
    return F.when(off < 1e-6, form(counts)).otherwise(form(values))


def add_diversity(df: DataFrame) -> DataFrame:
    """Product diversity (count and Gini-Simpson), store loyalty and store diversity."""
    added: dict[str, Column] = {}
    products = _shares(df, "product_")
    if products:
        added["product_diversity"] = total([F.col(c) for c in products])
        added["product_categories"] = total([(F.col(c) > 0).cast("int") for c in products])
        added["product_gini"] = gini_simpson(products, "frequency" if has(df, "frequency") else None)
    stores = _shares(df, "location_")
    if stores:
        added["location_loyalty"] = reduce(F.greatest, [F.col(c) for c in stores])
        added["location_diversity"] = total([(F.col(c) > 0).cast("int") for c in stores])
    return df.withColumns(added)


def add_features(df: DataFrame, parity: bool = True) -> DataFrame:
    """Loyalty features of a customer table, each only where its inputs exist.

    ``parity`` leaves out the four share-based features, as the recorded run does.
    """
    added: dict[str, Column] = {}
    if has(df, "bonus_usage_ratio", "bonus_earned_sum", "monetary"):
        added["bonus_earning_ratio"] = ratio(F.col("bonus_earned_sum"), F.col("monetary"))
    if has(df, "bonus_usage_ratio", "bonus_spent_sum", "bonus_earned_sum"):
        added["bonus_activity"] = (F.col("bonus_spent_sum") + F.col("bonus_earned_sum")) / 2
    if has(df, "recency", "activity_period"):
        added["recency_ratio"] = ratio(F.col("recency"), F.col("activity_period"))
    if has(df, "frequency", "activity_period"):
        added["purchase_density"] = ratio(F.col("frequency"), F.col("activity_period"))
    if has(df, "avg_purchase", "amount_std"):
        cv = ratio(F.col("amount_std"), F.col("avg_purchase"))
        added["amount_cv"] = cv
        added["purchase_stability"] = 1 - clip(cv, 0.0, 1.0)
    if has(df, *RFM_WEIGHTS):
        added["weighted_rfm"] = total([F.col(c) * F.lit(w) for c, w in RFM_WEIGHTS.items()])
    result = df.withColumns(added)
    return result if parity else add_diversity(result)


def score_expression(df: DataFrame, base_scale: str = "raw") -> Column:
    """0.7 x base + weighted bonus terms, cut to [0, 1].

    The base is the weighted RFM (1..4), or the first component without it. The raw base
    saturates the score at 1 for most customers; ``base_scale='unit'`` uses (w - 1) / 3.
    """
    if has(df, "weighted_rfm"):
        base = F.col("weighted_rfm")
        if base_scale == "unit":
            base = (base - 1) / 3
    else:
        base = F.col("pca_component_1")
    terms = [F.lit(BASE_WEIGHT) * base]
    for c, weight in BONUS_WEIGHTS.items():
        if has(df, c):
            value = clip(F.col(c), 0.0, 1.0) if c in CLIPPED_TERMS else F.col(c)
            terms.append(F.lit(weight) * value)
    return clip(total(terms), 0.0, 1.0)


def add_score(df: DataFrame, base_scale: str = "raw") -> DataFrame:
    scored = df.withColumn("loyalty_score", score_expression(df, base_scale))
    if has(df, "bonus_usage_ratio"):
        scored = scored.withColumn("bonus_usage_normalized", clip(F.col("bonus_usage_ratio"), 0.0, 1.0))
    return scored
