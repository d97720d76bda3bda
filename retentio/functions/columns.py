"""Column helpers shared by the operators; all are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def has(df: DataFrame, *names: str) -> bool:
    return all(name in df.columns for name in names)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Aggregates skip NULL but not NaN, so sources hand out NULL only."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def nonzero(c: Column) -> Column:
    return F.when(c == 0, F.lit(1)).otherwise(c)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division in which a zero denominator counts as one."""
    return numerator / nonzero(denominator)


def clip(c: Column, low: float, high: float) -> Column:
    # greatest/least skip nulls, so a null has to be kept explicitly
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def whole_days(later: Column, earlier: Column) -> Column:
    """Complete 24-hour days between two timestamps (``datediff`` ignores the time of day)."""
    return F.extract(F.lit("DAY"), later - earlier).cast("long")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def from_micros(c: Column, like: T.DataType) -> Column:
    return F.timestamp_micros(F.floor(c).cast("long")).cast(like)


def any_null(names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names], F.lit(False))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def row_mean(names: list[str]) -> Column:
    """Mean over the columns of a row, nulls skipped; null when all are null."""
    filled = total([F.coalesce(F.col(n), F.lit(0.0)) for n in names])
    present = total([F.col(n).isNotNull().cast("int") for n in names])
    return F.when(present > 0, filled / present)


def hash_key(*ids: Column, seed: int) -> Column:
    """Seeded 60-bit order key, reproducible outside Spark (md5 of ``seed|id|...``)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[i.cast("string") for i in ids])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def parse_timestamp(c: Column, *formats: str) -> Column:
    """First format that fits; bad text becomes null."""
    tries = [F.try_to_timestamp(c)] + [F.try_to_timestamp(c, F.lit(f)) for f in formats]
    return F.coalesce(*tries)


def pearson(x: Column, y: Column) -> Column:
    """Pearson r of complete pairs; null when either side is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
