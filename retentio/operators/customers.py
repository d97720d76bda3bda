"""One row per customer: purchase, bonus, and share aggregates."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions.columns import has, is_floating, micros, numeric_columns, ratio, total, whole_days
from retentio.session import materialize

ROW_ORDER = ["purchase_ts", "order_key", "line_number", "part_key", "amount"]


def first_in_order(df: DataFrame, column: str, order: list[str]) -> Column:
    """First non-null value along an explicit order; partial aggregates, no sort."""
    keys = [o for o in order if o in df.columns and o != column]
    rank = F.struct(*keys, column) if keys else F.col(column)
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), rank))


CODE_SPAN = Decimal(10**10)  # more than any 32-bit code; beside a timestamp it fits 38 digits


def earliest_code(code: Column, ts: str = "purchase_ts") -> Column:
    """Code of the earliest row, ties to the smallest code; decode with ``decoded``.

    A single number per customer keeps the whole aggregation a hash aggregation. ``min_by``
    over a struct would turn it into a sort of all rows before the map-side combine.
    """
    return F.min(micros(F.col(ts)).cast("decimal(20,0)") * F.lit(CODE_SPAN) + code.cast("decimal(10,0)"))


def decoded(packed: str) -> Column:
    return F.pmod(F.col(packed), F.lit(CODE_SPAN)).cast("int")


def purchase_aggregates(df: DataFrame, amount: str = "amount") -> list[Column]:
    """Count, sum, mean, and sample deviation of the amount."""
    return [
        F.count(amount).alias("frequency"),
        F.sum(amount).alias("monetary"),
        F.avg(amount).alias("avg_purchase"),
        F.stddev_samp(amount).alias("amount_std"),
    ]


def _share(df: DataFrame, flag: str) -> Column:
    """Mean of a flag; flags without nulls share one count of rows instead of keeping one each."""
    field = df.schema[flag]
    if field.nullable or not isinstance(field.dataType, T.IntegerType):
        return F.avg(flag)
    return F.sum(flag) / F.count(F.lit(1))


def aggregate_customers(df: DataFrame, key: str = "client_id", keep: bool = True) -> DataFrame:
    """Customer table. All aggregates combine map-side, so a huge customer stays harmless.

    With ``keep`` the grouped table is written once, because the days since the last
    purchase need its overall maximum.
    """
    if key not in df.columns:
        raise ValueError(f"missing key column {key}")
    aggregates: list[Column] = []
    if has(df, "amount"):
        aggregates += purchase_aggregates(df)
    if has(df, "purchase_ts"):
        aggregates += [F.min("purchase_ts").alias("first_ts"), F.max("purchase_ts").alias("last_ts")]
    for name in ("bonus_earned", "bonus_spent"):
        if has(df, name):
            aggregates += [F.sum(name).alias(f"{name}_sum"), F.avg(name).alias(f"{name}_mean")]
    decode: dict[str, Column] = {}
    if has(df, "gender_code", "purchase_ts"):
        aggregates.append(earliest_code(F.col("gender_code")).alias("gender_code"))
        decode["gender_code"] = decoded("gender_code")
    shares = [
        c for c in df.columns if c.startswith(("location_", "product_")) and c not in ("product_category", "product_name")
    ]
    aggregates += [_share(df, c).alias(c) for c in shares]
    flags = [c for c in shares if c.startswith("product_")]
    if has(df, "product_category", "purchase_ts") and flags:
        position = total([F.col(c) * i for i, c in enumerate(flags)])
        aggregates.append(earliest_code(position).alias("product_category"))
        names = F.array(*[F.lit(c.removeprefix("product_")) for c in flags])
        decode["product_category"] = F.try_element_at(names, decoded("product_category") + 1)
    grouped = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggregates).withColumns(decode)
    if keep:
        grouped = materialize(grouped, "customers")
    return add_periods(grouped)


def add_periods(customers: DataFrame, as_of=None) -> DataFrame:
    """Recency, activity period, bonus usage, and purchase frequency."""
    added: dict[str, Column] = {}
    if has(customers, "last_ts"):
        if as_of is None:
            as_of = customers.agg(F.max("last_ts")).first()[0]
        now = F.lit(as_of).cast(customers.schema["last_ts"].dataType)
        days = whole_days(now, F.col("last_ts"))
        added["recency"] = F.coalesce(F.greatest(F.lit(0), days), F.lit(0)).cast("long")
        span = whole_days(F.col("last_ts"), F.col("first_ts"))
        added["activity_period"] = F.coalesce(F.greatest(F.lit(1), span), F.lit(1)).cast("long")
    if has(customers, "bonus_spent_sum", "bonus_earned_sum"):
        added["bonus_usage_ratio"] = ratio(F.col("bonus_spent_sum"), F.col("bonus_earned_sum"))
    result = customers.withColumns(added)
    if has(result, "frequency", "activity_period"):
        result = result.withColumn("purchase_frequency", F.col("frequency") / F.col("activity_period"))
    return result


def explore_customers(df: DataFrame, key: str = "client_id") -> DataFrame:
    """Exploratory variant: total bonus columns instead of sums and means."""
    customers = aggregate_customers(df, key)
    return customers.select(
        key,
        "recency",
        "frequency",
        "monetary",
        "avg_purchase",
        "activity_period",
        F.col("bonus_earned_sum").alias("total_bonus_earned"),
        F.col("bonus_spent_sum").alias("total_bonus_used"),
    )


def aggregate_anything(df: DataFrame, key: str = "client_id", order: list[str] | None = None) -> DataFrame:
    """Fallback: mean and sum of every number, first value of everything else."""
    order = order or ROW_ORDER
    numbers = numeric_columns(df, (key,))
    others = [c for c in df.columns if c != key and c not in numbers]
    aggregates = []
    for c in numbers:
        total = F.sum(c) if is_floating(df, c) else F.sum(F.col(c).cast("long"))
        aggregates += [F.avg(c).alias(f"{c}_mean"), total.alias(f"{c}_sum")]
    aggregates += [first_in_order(df, c, order).alias(f"{c}_first") for c in others]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggregates)
