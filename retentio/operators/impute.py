"""Missing-value treatment: per-customer medians, global medians, modes and literals."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio import schema
from retentio.functions.columns import any_null, from_micros, micros
from retentio.operators.quantiles import exact_quantiles, grouped_quantiles
from retentio.session import materialize, setting


@dataclass
class Imputer:
    """Fitted fills. ``customer_medians`` is a table, everything else is small."""

    key: str
    median_columns: list[str] = field(default_factory=list)
    date_types: dict[str, T.DataType] = field(default_factory=dict)
    customer_medians: DataFrame | None = None
    global_medians: dict[str, float] = field(default_factory=dict)
    values: dict[str, str] = field(default_factory=dict)
    missing_before: int = 0

    def fill_by_customer(self, df: DataFrame) -> DataFrame:
        """Only rows that lack a value meet the median table; complete rows are not shuffled."""
        if self.customer_medians is None or self.key not in df.columns:
            return df
        lacking = any_null(self.median_columns)
        renamed = self.customer_medians.select(
            self.key, *[F.col(c).alias(f"_median_{c}") for c in self.median_columns]
        )
        filled = df.filter(lacking).join(renamed, self.key, "left")
        values = []
        for c in df.columns:
            if c not in self.median_columns:
                values.append(F.col(c))
            elif c in self.date_types:
                values.append(F.coalesce(F.col(c), from_micros(F.col(f"_median_{c}"), self.date_types[c])).alias(c))
            else:
                values.append(F.coalesce(F.col(c), F.col(f"_median_{c}")).alias(c))
        return df.filter(~lacking).unionByName(filled.select(*values))

    def fill_globally(self, df: DataFrame) -> DataFrame:
        fills = {}
        for c, v in self.global_medians.items():
            if c not in df.columns or v is None:
                continue
            constant = from_micros(F.lit(v), self.date_types[c]) if c in self.date_types else F.lit(v)
            fills[c] = F.coalesce(F.col(c), constant)
        for c, v in self.values.items():
            if c in df.columns and v is not None:
                fills[c] = F.coalesce(F.col(c), F.lit(v))
        return df.withColumns(fills) if fills else df

    def apply(self, df: DataFrame) -> DataFrame:
        return self.fill_globally(self.fill_by_customer(df))

    def apply_staged(self, df: DataFrame) -> DataFrame:
        """``apply`` for a written table that is read several times: only the rows that meet the
        median table are written again, the others stay a scan with constant fills. They are bucketed
        by customer: with a table that is bucketed alike, sums per customer need no shuffle."""
        if self.customer_medians is None or self.key not in df.columns:
            return self.fill_globally(df)
        lacking = any_null(self.median_columns)
        patched = materialize(self.fill_by_customer(df.filter(lacking)), "filled", "zstd", self.key)
        return self.fill_globally(df.filter(~lacking).unionByName(patched))


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value per column, ties to the smallest; counts are shuffled, not values."""
    if not columns:
        return {}
    counts = (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], columns, "column", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("top"))
    return {row["column"]: row["top"]["value"] for row in best.collect()}  # one row per column


def fit_imputer(
    df: DataFrame,
    key: str = "client_id",
    dates: list[str] = schema.DATE_COLUMNS,
    numerics: list[str] = schema.FILL_COLUMNS,
    mode_columns: tuple[str, ...] = ("gender",),
    categories: list[str] = schema.CATEGORY_COLUMNS,
    sparse_share: float = 0.05,
    unknown: str = schema.UNKNOWN,
) -> Imputer:
    counted = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    ).first()
    n = counted["_n"]
    lacking = {c for c in df.columns if counted[c]}
    fitted = Imputer(key, missing_before=sum(counted[c] for c in df.columns))

    date_part = [c for c in dates if c in lacking]
    fitted.median_columns = date_part + [c for c in numerics if c in lacking]
    fitted.date_types = {c: df.schema[c].dataType for c in date_part}
    if fitted.median_columns:
        numbers = [micros(F.col(c)).alias(c) if c in date_part else F.col(c) for c in fitted.median_columns]
        if key in df.columns:
            wanted = df.filter(any_null(fitted.median_columns)).select(key).distinct()
            known = df.select(key, *numbers).join(wanted, key, "left_semi")
            # the semi-join leaves the rows sorted by customer: medians one customer after the
            # other, where a hash table of all customers' values would spill
            with setting(df.sparkSession, "spark.sql.execution.replaceHashWithSortAgg", "true"):
                fitted.customer_medians = materialize(
                    grouped_quantiles(known, [key], fitted.median_columns, 0.5), "customer-medians"
                )
        partly = fitted.fill_by_customer(df)
        left = partly.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in fitted.median_columns]).first()
        remaining = [c for c in fitted.median_columns if left[c]]
        medians = exact_quantiles(
            partly, {c: micros(F.col(c)) if c in date_part else F.col(c) for c in remaining}, [0.5]
        )
        fitted.global_medians = {c: v[0] for c, v in medians.items()}

    by_mode = [c for c in mode_columns if c in lacking]
    by_mode += [c for c in categories if c in lacking and counted[c] / n < sparse_share]
    fitted.values = modes(df, by_mode)
    for c in categories:
        if c in lacking and c not in by_mode:
            fitted.values[c] = unknown
    return fitted


def fill_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """Column means for the gaps of a model matrix."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(means[c])) for c in columns if means[c] is not None}
    )


def fill_placeholders(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Fixed default per feature; absent columns are created."""
    return df.withColumns(
        {
            c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) if c in df.columns else F.lit(float(v))
            for c, v in defaults.items()
        }
    )
