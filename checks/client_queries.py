"""Client lists, segment statistics, history, cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import stages
from checks.registry import query, rounded, ts
from retentio.operators import clients
from retentio.operators.encode import product_category
from retentio.sources import retail


@query(
    "client_list",
    ["rfm"],
    "SELECT client_id, loyalty_segment, rfm_score FROM rfm WHERE loyalty_segment = 'Лояльные' AND contains(CAST(client_id AS VARCHAR), '1') ORDER BY client_id LIMIT 100 OFFSET 10",
)
def client_list(spark, folder):
    found = clients.client_list(stages.rfm_customers(spark, folder), "Лояльные", "1", skip=10, limit=100)
    return found.select("client_id", "loyalty_segment", "rfm_score")


@query(
    "client_details",
    ["rfm", "tx"],
    f"SELECT client_id, loyalty_segment, rfm_score, {ts('t.purchase_ts')} AS purchase_ts, t.store, t.product_name, round(t.amount, 2) AS amount FROM rfm JOIN tx t USING (client_id)",
)
def client_details(spark, folder):
    table = stages.rfm_customers(spark, folder).select("client_id", "loyalty_segment", "rfm_score")
    history = stages.tx(spark, folder).select("client_id", "purchase_ts", "store", "product_name", "amount")
    return rounded(clients.client_details(table, history), 2)


@query("segment_statistics", ["rfm"], "SELECT loyalty_segment, count(*) AS clients, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM rfm GROUP BY 1")
def segment_statistics(spark, folder):
    return rounded(clients.segment_statistics(stages.rfm_customers(spark, folder)))


THRESHOLDS = [("sleeping", 0.0, 0.25), ("at risk", 0.25, 0.5), ("loyal", 0.5, 0.75), ("champion", 0.75, 1.0)]


@query(
    "segment_by_thresholds",
    ["scored_unit"],
    "SELECT client_id, name AS threshold_segment FROM scored_unit JOIN (VALUES "
    + ", ".join(f"('{n}', {a}, {b})" for n, a, b in THRESHOLDS)
    + ") t(name, low, high) ON loyalty_score >= low AND (loyalty_score < high OR (high = 1 AND loyalty_score = 1))",
)
def segment_by_thresholds(spark, folder):
    return clients.segment_by_thresholds(stages.scored(spark, folder), THRESHOLDS).select("client_id", "threshold_segment")


ASSIGNED = """SELECT client_id, date_trunc('quarter', purchase_ts) AS assigned_at, CASE WHEN count(*) >= 3 THEN 'active' ELSE 'quiet' END AS segment FROM lines GROUP BY 1, 2"""


@query(
    "segment_history",
    ["lines"],
    f"""SELECT client_id, {ts('assigned_at')} AS assigned_at, segment, previous_segment, coalesce(previous_segment <> segment, false) AS changed FROM
        (SELECT *, lag(segment) OVER (PARTITION BY client_id ORDER BY assigned_at) AS previous_segment FROM ({ASSIGNED}))""",
)
def segment_history(spark, folder):
    lines = retail.order_lines(spark, folder)
    assigned = lines.groupBy("client_id", F.date_trunc("quarter", "purchase_ts").alias("assigned_at")).agg(
        F.when(F.count(F.lit(1)) >= 3, "active").otherwise("quiet").alias("segment")
    )
    return rounded(clients.segment_history(assigned))


@query(
    "upload_batches",
    ["purchases"],
    """SELECT CAST(year(purchase_ts) AS INT) AS batch, count(*) AS total_rows, count(*) FILTER (store IS NOT NULL AND amount IS NOT NULL) AS processed_rows,
       count(*) FILTER (store IS NULL OR amount IS NULL) AS rejected_rows FROM purchases GROUP BY 1""",
)
def upload_batches(spark, folder):
    uploads = retail.purchases(spark, folder).withColumn("batch", F.year("purchase_ts"))
    return clients.batch_log(uploads, "batch", ["store", "amount"])


@query(
    "relative_rfm",
    ["rfm"],
    "SELECT client_id, "
    + ", ".join(f"round(percent_rank() OVER (ORDER BY {m}), 6) AS {m}_percent_rank, round({m} / avg({m}) OVER (), 6) AS {m}_to_mean" for m in ("recency", "frequency", "activity_period"))
    + " FROM rfm",
)
def relative_rfm(spark, folder):
    names = ["recency", "frequency", "activity_period"]
    df = clients.relative_metrics(stages.rfm_customers(spark, folder).select("client_id", *names), names)
    return rounded(df.drop(*names))


@query(
    "category_mix",
    ["enc"],
    """SELECT client_id, count(*) AS categories, first(product_category ORDER BY n DESC, product_category) AS main_category FROM
       (SELECT client_id, product_category, count(*) AS n FROM enc GROUP BY 1, 2) GROUP BY 1""",
)
def category_mix(spark, folder):
    tx = retail.purchases(spark, folder).withColumn("product_category", product_category(F.col("product_name"), retail.PRODUCT_RULES))
    return clients.category_mix(tx)


ACTIVITY = "SELECT client_id, CAST(date_trunc('month', purchase_ts) AS DATE) AS month, sum(amount) AS amount, count(*) AS purchases FROM lines GROUP BY 1, 2"


@query(
    "retention",
    ["lines"],
    f"""SELECT CAST(month AS VARCHAR) AS month, count(*) AS active, count(again) AS retained, round(count(again) / count(*), 6) AS retention_rate, round(1 - count(again) / count(*), 6) AS churn_rate FROM
        (SELECT a.client_id, a.month, b.month AS again FROM ({ACTIVITY}) a LEFT JOIN ({ACTIVITY}) b ON a.client_id = b.client_id AND b.month = CAST(a.month + INTERVAL 1 MONTH AS DATE)) GROUP BY 1""",
)
def retention(spark, folder):
    df = clients.retention(clients.monthly_activity(retail.order_lines(spark, folder)))
    return rounded(df.withColumn("month", F.col("month").cast("string")))


@query(
    "cohort_retention",
    ["lines"],
    f"""SELECT CAST(cohort AS VARCHAR) AS cohort, CAST(date_diff('month', cohort, month) AS INT) AS age, count(*) AS active, max(clients) AS clients, round(count(*) / max(clients), 6) AS share FROM
        (SELECT a.client_id, month, cohort, count(DISTINCT a.client_id) OVER (PARTITION BY cohort) AS clients FROM ({ACTIVITY}) a JOIN (SELECT client_id, min(month) AS cohort FROM ({ACTIVITY}) GROUP BY 1) f ON a.client_id = f.client_id) GROUP BY 1, 2""",
)
def cohort_retention(spark, folder):
    df = clients.cohort_retention(clients.monthly_activity(retail.order_lines(spark, folder)))
    return rounded(df.withColumn("cohort", F.col("cohort").cast("string")))


@query(
    "lifetime_value",
    ["lines"],
    f"""SELECT client_id, CAST(CAST(sum(amount) / sum(purchases) AS REAL) AS DOUBLE) AS mean_check, round(sum(purchases) / (date_diff('month', min(month), max(month)) + 1), 6) AS purchases_per_month,
        CAST(date_diff('month', min(month), max(month)) + 1 AS INT) AS months, round(sum(amount), 2) AS lifetime_value FROM ({ACTIVITY}) GROUP BY 1""",
)
def lifetime_value(spark, folder):
    from checks.registry import SINGLE

    df = clients.lifetime_value(clients.monthly_activity(retail.order_lines(spark, folder)))
    return rounded(df, 6, mean_check=SINGLE, lifetime_value=2)
