"""Running sums and ranks over a total order, spread over range slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentio.session import materialize


def _slices(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, order: list, sums: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """Add inclusive running sums ``{new: source}`` along ``order`` within ``keys``.

    A window over the whole order would run in one task. The rows are cut into range
    slices instead; each slice is summed on its own and shifted by the total of the slices
    before it, a table of at most (slices x keys) rows.
    """
    keys = keys or []
    spark = df.sparkSession
    order_columns = [F.col(o) if isinstance(o, str) else o for o in order]
    sliced = materialize(
        df.repartitionByRange(_slices(spark), *keys, *order_columns).withColumn(
            "_slice", F.spark_partition_id()
        ),
        "slices",
    )
    totals = sliced.groupBy(*keys, "_slice").agg(*[F.sum(s).alias(f"_t_{n}") for n, s in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        *keys,
        "_slice",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
    )
    within = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(*order_columns)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = sliced.join(shifts, [*keys, "_slice"])
    return joined.select(
        *df.columns,
        *[(F.sum(s).over(within) + F.col(f"_b_{n}")).alias(n) for n, s in sums.items()],
    )


def with_row_index(df: DataFrame, order: list, name: str = "_index", keys: list[str] | None = None) -> DataFrame:
    """Gap-free 0-based index along ``order`` (within ``keys``)."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    ranked = running_total(one, order, {name: "_one"}, keys)
    return ranked.drop("_one").withColumn(name, F.col(name) - 1)


def percent_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<c>_percent_rank`` = share of strictly smaller values among the others.

    Works on the counts of distinct values, so ties cost nothing, and joins them back.
    """
    result = df
    for c in columns:
        counted = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_k"))
        ranked = running_total(counted, [c], {"_upto": "_k"})
        n = df.agg(F.count(c)).first()[0]
        share = (F.col("_upto") - F.col("_k")) / F.lit(max(n - 1, 1))
        result = result.join(ranked.select(c, share.alias(f"{c}_percent_rank")), c, "left")
    return result
