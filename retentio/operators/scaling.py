"""Winsorising and scaling: fitted numbers plus plain expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio import schema
from retentio.operators.quantiles import exact_quantiles


@dataclass
class Fences:
    q1: float
    q3: float
    low: float
    high: float


def fit_fences(df: DataFrame, columns: list[str] | None = None) -> dict[str, Fences]:
    """Q1 - 1.5 IQR and Q3 + 1.5 IQR of each column."""
    columns = [c for c in (columns or schema.OUTLIER_COLUMNS) if c in df.columns]
    fences = {}
    for c, (q1, q3) in exact_quantiles(df, columns, [0.25, 0.75]).items():
        if q1 is not None:
            fences[c] = Fences(q1, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return fences


def count_outliers(df: DataFrame, fences: dict[str, Fences]) -> DataFrame:
    parts = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(f.low).alias("low"),
            F.lit(f.high).alias("high"),
            F.count_if((F.col(c) < f.low) | (F.col(c) > f.high)).alias("outliers"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        for c, f in fences.items()
    ]
    long = df.agg(F.array(*parts).alias("_all")).select(F.inline("_all"))
    return long.withColumn("percent", F.col("outliers") * 100.0 / F.col("n_rows"))


def winsorise(df: DataFrame, fences: dict[str, Fences]) -> DataFrame:
    """Cut at the upper fence; at the lower one only where that fence is positive."""
    values = {}
    for c, f in fences.items():
        if c not in df.columns:
            continue
        x = F.col(c)
        cut = F.when(x > f.high, F.lit(f.high))
        if f.low > 0:
            cut = cut.when(x < f.low, F.lit(f.low))
        values[c] = cut.otherwise(x)
    return df.withColumns(values)


@dataclass
class Scaler:
    """``(x - shift) / width`` per column; a constant column gives 0."""

    shift: dict[str, float]
    width: dict[str, float]

    def expression(self, c: str):
        if not self.width[c]:
            return F.when(F.col(c).isNotNull(), F.lit(0.0))
        return (F.col(c) - F.lit(self.shift[c])) / F.lit(self.width[c])

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.expression(c) for c in self.shift if c in df.columns})


def fit_scaler(
    df: DataFrame, to_unit: list[str] | None = None, to_standard: list[str] | None = None
) -> Scaler:
    """Min-max for ``to_unit``, population standardisation for ``to_standard``; one pass."""
    unit = [c for c in (schema.MONEY_COLUMNS if to_unit is None else to_unit) if c in df.columns]
    standard = [c for c in (schema.RATE_COLUMNS if to_standard is None else to_standard) if c in df.columns]
    row = df.agg(
        *[F.min(c).cast("double").alias(f"lo_{c}") for c in unit],
        *[F.max(c).cast("double").alias(f"hi_{c}") for c in unit],
        *[F.avg(c).alias(f"mean_{c}") for c in standard],
        *[F.stddev_pop(c).alias(f"sd_{c}") for c in standard],
    ).first()
    shift = {c: row[f"lo_{c}"] or 0.0 for c in unit} | {c: row[f"mean_{c}"] or 0.0 for c in standard}
    width = {c: (row[f"hi_{c}"] or 0.0) - (row[f"lo_{c}"] or 0.0) for c in unit}
    width |= {c: row[f"sd_{c}"] or 0.0 for c in standard}
    return Scaler(shift, width)
