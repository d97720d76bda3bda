"""Recency, frequency, monetary scores and the segments derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.functions.columns import has
from retentio.operators.profile import fixed_order, segment_profile
from retentio.operators.quantiles import exact_quantiles
from retentio.session import materialize

METRICS = ["recency", "frequency", "monetary"]

# Lowest score of each segment, best first.
SEGMENTS = [(9, "Высоколояльные"), (7, "Лояльные"), (5, "Умеренно лояльные"), (3, "Низколояльные")]
CHURN = "Отток"
EXPLORE_SEGMENTS = [(10, "Высоколояльные"), (8, "Умеренно лояльные"), (6, "Низколояльные"), (4, "Потенциально лояльные")]
EXPLORE_CHURN = "Группа оттока"


def missing_metrics(df: DataFrame) -> list[str]:
    return [m for m in METRICS if m not in df.columns]


def fit_cuts(customers: DataFrame) -> dict[str, list[float]]:
    absent = missing_metrics(customers)
    if absent:
        raise ValueError(f"RFM needs the columns {', '.join(absent)}")
    return exact_quantiles(customers, METRICS, [0.25, 0.5, 0.75])


def _score(column: str, cuts: list[float], scores: list[int]) -> Column:
    x = F.col(column)
    chain = F.when(x <= cuts[0], scores[0]).when(x <= cuts[1], scores[1]).when(x <= cuts[2], scores[2])
    return chain.otherwise(scores[3])


def by_threshold(score: Column, thresholds: list[tuple[int, str]], below: str) -> Column:
    chain = None
    for low, name in thresholds:
        chain = F.when(score >= low, name) if chain is None else chain.when(score >= low, name)
    return chain.otherwise(below)


def apply_rfm(customers: DataFrame, cuts: dict[str, list[float]], segments=SEGMENTS, below: str = CHURN) -> DataFrame:
    scored = customers.withColumns(
        {
            "R": _score("recency", cuts["recency"], [4, 3, 2, 1]),
            "F": _score("frequency", cuts["frequency"], [1, 2, 3, 4]),
            "M": _score("monetary", cuts["monetary"], [1, 2, 3, 4]),
        }
    )
    scored = scored.withColumns(
        {"rfm_group": F.concat("R", "F", "M"), "rfm_score": F.col("R") + F.col("F") + F.col("M")}
    )
    return scored.withColumn("loyalty_segment", by_threshold(F.col("rfm_score"), segments, below))


def sparse_columns(df: DataFrame, share: float = 0.30) -> list[str]:
    row = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    ).first()
    return [c for c in df.columns if row["_n"] and row[c] / row["_n"] > share]


def prepare_customers(customers: DataFrame, sparse_share: float = 0.30) -> DataFrame:
    """Score everyone, then drop sparse columns and incomplete customers."""
    dropped = sparse_columns(customers, sparse_share)
    if not missing_metrics(customers):
        customers = apply_rfm(customers, fit_cuts(customers))
    return customers.drop(*dropped).dropna("any")


def two_pass_rfm(customers: DataFrame) -> DataFrame:
    """The scores of the survivors are cut at the survivors' own quartiles."""
    survivors = materialize(prepare_customers(customers), "rfm")
    return prepare_customers(survivors)


def explore_rfm(customers: DataFrame) -> DataFrame:
    return apply_rfm(customers, fit_cuts(customers), EXPLORE_SEGMENTS, EXPLORE_CHURN)


def segment_statistics(scored: DataFrame, segment: str = "loyalty_segment") -> DataFrame:
    return segment_profile(scored, segment, [m for m in [*METRICS, "avg_purchase"] if has(scored, m)])


def ordered_segments(
    scored: DataFrame, segment: str = "loyalty_segment", segments=SEGMENTS, below: str = CHURN
) -> DataFrame:
    """Counts in the fixed order of the segment names, absent ones kept."""
    counts = scored.groupBy(segment).agg(F.count(F.lit(1)).alias("n"))
    return fixed_order(counts, segment, [name for _, name in segments] + [below])
