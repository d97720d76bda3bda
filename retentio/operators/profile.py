"""Profiling and exploratory summaries of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentio.functions.columns import numeric_columns, pearson, string_columns, whole_days
from retentio.operators.quantiles import exact_quantiles
from retentio.session import materialize

BROADCAST_CATEGORIES = 100_000  # density statistics rows sent to every task at most

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def peek(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)


def shape(df: DataFrame) -> DataFrame:
    """Row count, column count, and one row per column with its type."""
    spark = df.sparkSession
    fields = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column string, type string",
    )
    return fields.withColumn("n_columns", F.lit(len(df.columns))).withColumn("n_rows", F.lit(df.count()).cast("long"))


def _wide_to_long(wide: DataFrame, names: list[str], value: str) -> DataFrame:
    """One-row aggregate with a column per name -> one row per name."""
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").alias(value)) for n in names])
    return wide.select(F.inline(pairs), *[c for c in wide.columns if c not in names])


def missing_counts(df: DataFrame) -> DataFrame:
    """Null count of every column, one pass."""
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns], F.count(F.lit(1)).alias("_n"))
    return _wide_to_long(wide, df.columns, "missing")


def missing_profile(df: DataFrame) -> DataFrame:
    """Columns with nulls, worst first."""
    return (
        missing_counts(df)
        .withColumn("percent", F.col("missing") * 100.0 / F.nullif(F.col("_n"), F.lit(0)))
        .filter("missing > 0")
        .select("column", "missing", "percent")
        .orderBy(F.desc("percent"), "column")
    )


def missing_total(df: DataFrame) -> DataFrame:
    return missing_counts(df).agg(F.sum("missing").alias("missing"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row.

    Only an 8-byte row hash is shuffled for the whole table; full rows are grouped just
    for hashes seen more than once, so hash collisions cannot change the count.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*df.columns))
    counts = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_k"))
    repeated = counts.filter("_k > 1").select("_hash")
    groups = hashed.join(repeated, "_hash", "left_semi").groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_k"))
    extra = groups.agg(F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).alias("duplicates"))
    n = df.count()
    return extra.select(
        F.lit(n).cast("long").alias("n_rows"),
        "duplicates",
        (F.col("duplicates") * 100.0 / F.lit(max(n, 1))).alias("percent"),
    )


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles, max; quartiles are exact."""
    columns = columns or numeric_columns(df)
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    parts = []
    for c in columns:
        x = F.col(c)
        q = [F.lit(v) for v in quartiles[c]]
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x).alias("count"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(x).cast("double").alias("min"),
                q[0].cast("double").alias("q25"),
                q[1].cast("double").alias("q50"),
                q[2].cast("double").alias("q75"),
                F.max(x).cast("double").alias("max"),
            )
        )
    return df.agg(F.array(*parts).alias("_all")).select(F.inline("_all"))


def value_counts_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) for several columns in one shuffle of partial counts."""
    return (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], columns, "column", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def cardinality(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct values per string column."""
    counts = value_counts_long(df, columns or string_columns(df))
    return counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"), F.sum("n").alias("n_values"))


def small_value_counts(df: DataFrame, columns: list[str] | None = None, at_most: int = 10) -> DataFrame:
    """Value counts and shares of the columns with few distinct values."""
    counts = value_counts_long(df, columns or string_columns(df))
    sizes = counts.groupBy("column").agg(F.count(F.lit(1)).alias("_u"), F.sum("n").alias("_n"))
    small = sizes.filter(F.col("_u") <= at_most)
    return counts.join(small, "column").select(
        "column", "value", "n", (F.col("n") * 100.0 / F.col("_n")).alias("percent")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
    )


def date_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "date" in c.lower() or "дата" in c.lower()]


def date_ranges(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """First, last, and span of every date column; text that is no date counts as null."""
    columns = columns or date_columns(df)
    parts = []
    for c in columns:
        ts = F.try_to_timestamp(F.col(c).cast("string"))
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.min(ts).alias("first"),
                F.max(ts).alias("last"),
                whole_days(F.max(ts), F.min(ts)).alias("span_days"),
                F.count_if(F.col(c).isNotNull() & ts.isNull()).alias("bad_values"),
            )
        )
    return df.agg(F.array(*parts).alias("_all")).select(F.inline("_all"))


def coerce_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to timestamps; values that do not parse become null."""
    return df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string")) for c in columns if c in df.columns})


def period(df: DataFrame, column: str = "purchase_ts") -> DataFrame:
    ts = F.col(column)
    return df.agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), whole_days(F.max(ts), F.min(ts)).alias("days")
    )


def _with_median(per_client: DataFrame, column: str, name: str, parts: list[Column]) -> DataFrame:
    median = exact_quantiles(per_client, [column], [0.5])[column][0]
    return per_client.agg(*parts, F.lit(median).cast("double").alias(f"median_{name}"))


def activity_stats(df: DataFrame, key: str = "client_id") -> DataFrame:
    """Distinct customers and the distribution of transactions per customer."""
    per_client = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return _with_median(
        per_client,
        "n",
        "transactions",
        [F.count(F.lit(1)).alias("customers"), F.avg("n").alias("mean_transactions"), F.max("n").alias("max_transactions")],
    )


def spend_stats(df: DataFrame, key: str = "client_id", amount: str = "amount") -> DataFrame:
    """Average check and total spend per customer, summarised."""
    per_client = (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.avg(amount).alias("check"), F.sum(amount).alias("spend"))
    )
    medians = exact_quantiles(per_client, ["check", "spend"], [0.5])
    return per_client.agg(
        F.avg("check").alias("mean_check"),
        F.lit(medians["check"][0]).cast("double").alias("median_check"),
        F.avg("spend").alias("mean_spend"),
        F.lit(medians["spend"][0]).cast("double").alias("median_spend"),
        F.max("spend").alias("max_spend"),
    )


def top_by_count(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return value_counts(df, column).limit(n)


def top_by_mean(df: DataFrame, column: str, value: str, n: int = 10) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("mean"), column)
        .limit(n)
    )


def histogram(df: DataFrame, column: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Equal-width counts between min and max; the last bin is closed on the right."""
    low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    width = ((high - low) / bins) or 1.0 if low is not None else 1.0
    low = low or 0.0
    index = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    keys = [by] if by else []
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(*keys, index.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("left", F.lit(low) + F.col("bin") * F.lit(width))
        .withColumn("right", F.lit(low) + (F.col("bin") + 1) * F.lit(width))
    )


def density(df: DataFrame, column: str, points: int = 40, by: str | None = None) -> DataFrame:
    """Gaussian kernel density on an even grid per category, Scott bandwidth.

    Two aggregates whatever the number of categories: statistics per category, then all
    kernel sums of all categories at once (partial sums before the shuffle). The statistics
    reach the rows by a broadcast while there are at most ``BROADCAST_CATEGORIES`` of them,
    else by a join. Categories with one value or no spread have no curve.
    """
    keys = [by] if by else []
    rows = df.select(*keys, F.col(column).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    stats = (
        rows.groupBy(*keys)
        .agg(F.count("_x").alias("_n"), F.stddev_samp("_x").alias("_s"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        .filter("_n > 1 and _s > 0")
        .withColumn("_h", F.col("_s") * F.pow(F.col("_n"), F.lit(-0.2)))
        .withColumn("_step", (F.col("_hi") - F.col("_lo")) / F.lit(points - 1))
        .withColumn("_scale", F.lit(1.0) / (F.col("_n") * F.col("_h") * F.lit((2 * 3.141592653589793) ** 0.5)))
        .select(*[F.col(k).alias("_key") for k in keys], F.lit(0).alias("_one"), "_lo", "_step", "_h", "_scale")
    )
    if by:
        fitted = materialize(stats, "density-stats")
        small = fitted.count() <= BROADCAST_CATEGORIES
        joined = rows.join(F.broadcast(fitted) if small else fitted, F.col(by).eqNullSafe(F.col("_key")))
    else:
        joined = rows.withColumn("_one", F.lit(0)).join(F.broadcast(stats), "_one")  # one row
    x, lo, step, h = F.col("_x"), F.col("_lo"), F.col("_step"), F.col("_h")
    sums = [F.sum(F.exp(F.lit(-0.5) * F.pow((x - (lo + F.lit(i) * step)) / h, F.lit(2.0)))).alias(f"_d{i}") for i in range(points)]
    summed = joined.groupBy(*keys, "_lo", "_step", "_scale").agg(*sums)
    curve = F.array(
        *[
            F.struct(F.lit(i).alias("point"), (lo + F.lit(i) * step).alias("x"), (F.col(f"_d{i}") * F.col("_scale")).alias("density"))
            for i in range(points)
        ]
    )
    return summed.select(*keys, F.inline(curve))


def box_plot(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 IQR, and points beyond them."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    parts = []
    for c in columns:
        q1, q2, q3 = quartiles[c]
        x = F.col(c).cast("double")
        low, high = F.lit(q1 - 1.5 * (q3 - q1)), F.lit(q3 + 1.5 * (q3 - q1))
        inside = F.when((x >= low) & (x <= high), x)
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(q1).alias("q1"),
                F.lit(q2).alias("median"),
                F.lit(q3).alias("q3"),
                F.min(inside).alias("whisker_low"),
                F.max(inside).alias("whisker_high"),
                F.count_if((x < low) | (x > high)).alias("outliers"),
            )
        )
    return df.agg(F.array(*parts).alias("_all")).select(F.inline("_all"))


def fixed_order(df: DataFrame, column: str, values: list) -> DataFrame:
    """Every listed value once, in the given order; values without data keep nulls."""
    spark = df.sparkSession
    calendar = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"position int, {column} {dict(df.dtypes)[column]}")
    return calendar.join(df, column, "left").orderBy("position")


def weekday_counts(df: DataFrame, column: str = "purchase_ts") -> DataFrame:
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.date_format(column, "EEEE").alias("weekday"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return fixed_order(counts, "weekday", WEEKDAYS)


def month_day_counts(df: DataFrame, column: str = "purchase_ts") -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.dayofmonth(column).alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("day")
    )


def hour_counts(df: DataFrame, column: str = "purchase_ts") -> DataFrame:
    """Counts per hour, empty when the data has no time of day."""
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.hour(column).alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    hours = counts.withColumn("_hours", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    return hours.filter("_hours > 1").drop("_hours").orderBy("hour")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson r of every pair, rows with a null in the pair skipped.

    One pass and one aggregate: each pair is a few partial moments of the masked columns,
    combined before anything is shuffled; no row is copied per pair.
    """
    columns = columns or numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    upper = pearson_table(df, pairs)
    lower = upper.filter("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"), "r")
    return upper.unionByName(lower)


def pearson_table(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, r) per pair; r is null when either side is constant or no row has both."""
    moments = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        moments.append(pearson(F.when(both, x), F.when(both, y)).alias(f"_r{i}"))
    row = df.agg(*moments)  # one row of len(pairs) numbers
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*cells)))


def strong_correlations(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    return correlation_matrix(df, columns).filter(F.abs("r") > threshold)


def metric_pairs(df: DataFrame, pairs: list[tuple[str, str]], key: str = "client_id") -> DataFrame:
    """Long scatter data: one row per customer and pair."""
    parts = F.array(
        *[
            F.struct(F.lit(f"{a}~{b}").alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
            for a, b in pairs
        ]
    )
    return df.select(key, F.inline(parts))


def segment_profile(df: DataFrame, segment: str, metrics: list[str]) -> DataFrame:
    """Mean of the metrics and size of every segment."""
    return df.groupBy(segment).agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics], F.count(F.lit(1)).alias("n"))
