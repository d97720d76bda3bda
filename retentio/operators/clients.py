"""Client lists, segment statistics, history, and cohort measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentio.operators.ranking import percent_ranks


def client_list(clients: DataFrame, segment: str | None = None, search: str | None = None, skip: int = 0, limit: int | None = 100, fields: tuple[str, ...] = ("client_id",), segment_column: str = "loyalty_segment") -> DataFrame:
    """Filter by segment, case-insensitive text search over the fields, paging by client id."""
    found = clients
    if segment is not None:
        found = found.filter(F.col(segment_column) == segment)
    if search is not None:
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.contains(F.lower(F.col(f).cast("string")), F.lit(search.lower()))
        found = found.filter(hit)
    ordered = found.orderBy("client_id")
    if skip:
        ordered = ordered.offset(skip)
    return ordered.limit(limit) if limit is not None else ordered


def client_details(clients: DataFrame, transactions: DataFrame, ids: list | None = None) -> DataFrame:
    """Client fields with one row per purchase: a history of any length stays in rows."""
    if ids is not None:
        clients = clients.filter(F.col("client_id").isin(ids))
        transactions = transactions.filter(F.col("client_id").isin(ids))
    return clients.join(transactions, "client_id")


def segment_statistics(clients: DataFrame, segment: str = "loyalty_segment") -> DataFrame:
    counts = clients.groupBy(segment).agg(F.count(F.lit(1)).alias("clients"))
    whole = Window.partitionBy(F.lit(0))
    return counts.withColumn("percent", F.col("clients") * 100.0 / F.sum("clients").over(whole))


def segment_by_thresholds(clients: DataFrame, thresholds: list[tuple[str, float, float]], score: str = "loyalty_score") -> DataFrame:
    """Segment whose [minimum, maximum) holds the score; the top one includes its maximum."""
    top = max(t[2] for t in thresholds)
    chain = None
    for name, low, high in thresholds:
        hit = (F.col(score) >= low) & ((F.col(score) < high) | (F.lit(high == top) & (F.col(score) == high)))
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return clients.withColumn("threshold_segment", chain)


def segment_history(assignments: DataFrame, key: str = "client_id", at: str = "assigned_at", segment: str = "segment") -> DataFrame:
    """Previous segment and change flag; ``assignments`` has one row per client and date."""
    order = Window.partitionBy(key).orderBy(at)
    previous = F.lag(segment).over(order)
    return assignments.withColumn("previous_segment", previous).withColumn(
        "changed", F.coalesce(previous != F.col(segment), F.lit(False))
    )


def batch_log(uploads: DataFrame, batch: str, required: list[str]) -> DataFrame:
    """Per batch: rows received, rows with every required field, rows rejected."""
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    return uploads.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(complete).alias("processed_rows"),
        F.count_if(~complete).alias("rejected_rows"),
    )


def relative_metrics(customers: DataFrame, metrics: list[str]) -> DataFrame:
    """RFM extensions: percentile rank and ratio to the mean, relationship length."""
    means = customers.agg(*[F.avg(m).alias(m) for m in metrics]).first()
    ranked = percent_ranks(customers, metrics)
    return ranked.withColumns(
        {f"{m}_to_mean": F.when(F.lit(means[m] or 0.0) != 0, F.col(m) / F.lit(means[m] or 1.0)) for m in metrics}
    )


def category_mix(transactions: DataFrame) -> DataFrame:
    """Number of product categories and the largest one per customer (category dimension of RFM)."""
    per = transactions.groupBy("client_id", "product_category").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("categories"),
        F.min(F.struct((-F.col("n")).alias("n"), "product_category"))["product_category"].alias("main_category"),
    )


def monthly_activity(transactions: DataFrame, key: str = "client_id") -> DataFrame:
    """One row per client and month of purchase: the base of the cohort measures."""
    return (
        transactions.filter(F.col(key).isNotNull())
        .groupBy(key, F.trunc(F.col("purchase_ts").cast("date"), "month").alias("month"))
        .agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("purchases"))
    )


def retention(activity: DataFrame, key: str = "client_id") -> DataFrame:
    """Per month: active clients, those active again next month, retention and churn."""
    now = activity.select(key, "month")
    later = activity.select(key, F.add_months("month", -1).alias("month"), F.lit(1).alias("again"))
    joined = now.join(later, [key, "month"], "left")
    counted = joined.groupBy("month").agg(F.count(F.lit(1)).alias("active"), F.count("again").alias("retained"))
    rate = F.col("retained") / F.col("active")
    return counted.withColumns({"retention_rate": rate, "churn_rate": 1 - rate})


def cohort_retention(activity: DataFrame, key: str = "client_id") -> DataFrame:
    """Share of each first-month cohort active n months later."""
    first = activity.groupBy(key).agg(F.min("month").alias("cohort"))
    aged = activity.join(first, key).withColumn(
        "age", F.round(F.months_between("month", "cohort")).cast("int")
    )
    sizes = first.groupBy("cohort").agg(F.count(F.lit(1)).alias("clients"))
    active = aged.groupBy("cohort", "age").agg(F.count(F.lit(1)).alias("active"))
    return active.join(sizes, "cohort").withColumn("share", F.col("active") / F.col("clients"))


def lifetime_value(activity: DataFrame, key: str = "client_id") -> DataFrame:
    """Average check x purchases per active month x months between first and last month."""
    span = F.round(F.months_between(F.max("month"), F.min("month"))).cast("int") + 1
    return activity.groupBy(key).agg(
        (F.sum("amount") / F.sum("purchases")).alias("mean_check"),
        (F.sum("purchases") / span).alias("purchases_per_month"),
        span.alias("months"),
        F.sum("amount").alias("lifetime_value"),
    )
