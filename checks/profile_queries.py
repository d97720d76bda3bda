"""Sources, profiling, cleaning, and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import stages
from checks.registry import SINGLE, query, rounded, single, ts
from checks.sql import OTHER, PRODUCT_CATEGORIES, days, high, low
from retentio import schema
from retentio.operators import encode, impute, profile, scaling
from retentio.operators.quantiles import exact_quantiles
from retentio.session import scratch_path
from retentio.sources import files, retail

NUMBERS = ["amount", "quantity", "external_discount", "bonus_earned", "bonus_spent"]

# --- sources and sinks


@query(
    "csv_round_trip",
    ["purchases"],
    "SELECT store, count(*) AS n, count(amount) AS n_amount, round(sum(amount), 2) AS amount FROM purchases GROUP BY store",
)
def csv_round_trip(spark, folder):
    path = scratch_path(spark, "csv")
    files.write_csv(retail.purchases(spark, folder).select("client_id", "store", "amount", "purchase_ts"), path)
    back = files.read_transactions(spark, path)
    return rounded(
        back.groupBy("store").agg(F.count(F.lit(1)).alias("n"), F.count("amount").alias("n_amount"), F.sum("amount").alias("amount")), 2
    )


@query(
    "stage_resume",
    ["lines"],
    f"SELECT client_id, count(*) AS n, {ts('max(purchase_ts)')} AS last_ts FROM lines GROUP BY client_id",
)
def stage_resume(spark, folder):
    place = scratch_path(spark, "stages")
    files.Stages(spark, place).get("lines", lambda: retail.order_lines(spark, folder))
    lines = files.Stages(spark, place, resume=("lines",)).get("lines", lambda: None)
    return rounded(lines.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"), F.max("purchase_ts").alias("last_ts")))


@query(
    "results_json_round_trip",
    ["purchases"],
    'SELECT product_name, count(*) AS n FROM purchases GROUP BY product_name',
)
def results_json_round_trip(spark, folder):
    path = scratch_path(spark, "json")
    files.write_json(profile.value_counts(retail.purchases(spark, folder), "product_name"), path)
    return spark.read.schema("product_name string, n long").json(path)


@query(
    "table_shape",
    [],
    """SELECT CAST(p AS INT) AS position, c AS "column", t AS type, (SELECT count(*) FROM lineitem) AS n_rows, 11 AS n_columns FROM (VALUES
       (0,'l_orderkey','bigint'),(1,'l_partkey','bigint'),(2,'l_suppkey','bigint'),(3,'l_linenumber','int'),(4,'l_quantity','double'),
       (5,'l_extendedprice','double'),(6,'l_discount','double'),(7,'l_tax','double'),(8,'l_returnflag','string'),(9,'l_linestatus','string'),
       (10,'l_shipdate','timestamp_ntz')) v(p, c, t)""",
)
def table_shape(spark, folder):
    return profile.shape(retail.table(spark, folder, "lineitem"))


# --- profiling


@query(
    "missing_profile",
    ["tx"],
    """SELECT "column", missing, round(missing * 100.0 / (SELECT count(*) FROM tx), 6) AS percent FROM
       (SELECT unnest(['gender','card_store','store','amount','card_date']) AS "column",
        unnest([count(*) - count(gender), count(*) - count(card_store), count(*) - count(store), count(*) - count(amount), count(*) - count(card_date)]) AS missing FROM tx) WHERE missing > 0""",
)
def missing_profile(spark, folder):
    return rounded(profile.missing_profile(stages.tx(spark, folder)))


@query(
    "duplicate_rows",
    [],
    """SELECT sum(n)::BIGINT AS n_rows, (sum(n) - count(*))::BIGINT AS duplicates, round((sum(n) - count(*)) * 100.0 / sum(n), 6) AS percent
       FROM (SELECT lineitem, count(*) AS n FROM lineitem GROUP BY lineitem)""",
)
def duplicate_rows(spark, folder):
    return rounded(profile.duplicate_rows(retail.table(spark, folder, "lineitem")))


@query(
    "describe_numeric",
    ["lines"],
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
            round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 6) AS q25, round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 6) AS q50,
            round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 6) AS q75, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM lines"""
        for c in NUMBERS
    ),
)
def describe_numeric(spark, folder):
    lines = retail.order_lines(spark, folder)
    return rounded(profile.describe_numeric(lines, NUMBERS), 6, mean=4, std=4)


@query(
    "cardinality",
    ["purchases"],
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique, count({c}) AS n_values FROM purchases"""
        for c in ("gender", "card_store", "store", "product_name")
    ),
)
def cardinality(spark, folder):
    return profile.cardinality(retail.purchases(spark, folder), ["gender", "card_store", "store", "product_name"])


@query(
    "small_value_counts",
    ["purchases"],
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent
            FROM purchases WHERE {c} IS NOT NULL AND (SELECT count(DISTINCT {c}) FROM purchases) <= 10 GROUP BY {c}"""
        for c in ("gender", "store", "product_name")
    ),
)
def small_value_counts(spark, folder):
    return rounded(profile.small_value_counts(retail.purchases(spark, folder), ["gender", "store", "product_name"]))


@query("value_counts", ["purchases"], "SELECT card_store, count(*) AS n FROM purchases WHERE card_store IS NOT NULL GROUP BY card_store")
def value_counts(spark, folder):
    return profile.value_counts(retail.purchases(spark, folder), "card_store")


@query(
    "date_ranges",
    ["tx"],
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {ts(f'min({c})')} AS first, {ts(f'max({c})')} AS last, {days(f'max({c})', f'min({c})')} AS span_days,
            CAST(0 AS BIGINT) AS bad_values FROM tx"""
        for c in ("card_date", "first_check_date", "last_check_date")
    ),
)
def date_ranges(spark, folder):
    return rounded(profile.date_ranges(stages.tx(spark, folder), ["card_date", "first_check_date", "last_check_date"]))


@query(
    "date_coercion",
    ["lines"],
    f"SELECT client_id, count(*) AS n, count(*) FILTER (quantity <> 13) AS n_dates, {ts('max(CASE WHEN quantity <> 13 THEN purchase_ts END)')} AS last_ts FROM lines GROUP BY client_id",
)
def date_coercion(spark, folder):
    lines = retail.order_lines(spark, folder)
    text = F.when(F.col("quantity") == 13, F.lit("not a date")).otherwise(F.date_format("purchase_ts", "yyyy-MM-dd HH:mm:ss"))
    dated = profile.coerce_dates(lines.withColumn("purchase_ts", text), ["purchase_ts"])
    return rounded(
        dated.groupBy("client_id").agg(
            F.count(F.lit(1)).alias("n"), F.count("purchase_ts").alias("n_dates"), F.max("purchase_ts").alias("last_ts")
        )
    )


@query(
    "period",
    ["lines"],
    f"SELECT {ts('min(purchase_ts)')} AS first, {ts('max(purchase_ts)')} AS last, {days('max(purchase_ts)', 'min(purchase_ts)')} AS days FROM lines",
)
def period(spark, folder):
    return rounded(profile.period(retail.order_lines(spark, folder)))


@query(
    "activity_stats",
    ["lines"],
    """SELECT count(*) AS customers, round(avg(n), 6) AS mean_transactions, max(n) AS max_transactions, round(CAST(quantile_cont(n, 0.5) AS DOUBLE), 6) AS median_transactions
       FROM (SELECT client_id, count(*) AS n FROM lines GROUP BY client_id)""",
)
def activity_stats(spark, folder):
    return rounded(profile.activity_stats(retail.order_lines(spark, folder)))


@query(
    "spend_stats",
    ["lines"],
    """SELECT round(avg(c), 4) AS mean_check, round(quantile_cont(c, 0.5), 4) AS median_check, round(avg(s), 4) AS mean_spend,
       round(quantile_cont(s, 0.5), 4) AS median_spend, round(max(s), 4) AS max_spend
       FROM (SELECT client_id, avg(amount) AS c, sum(amount) AS s FROM lines GROUP BY client_id)""",
)
def spend_stats(spark, folder):
    return rounded(profile.spend_stats(retail.order_lines(spark, folder)), 4)


@query("top_stores", ["purchases"], "SELECT store, count(*) AS n FROM purchases WHERE store IS NOT NULL GROUP BY store ORDER BY n DESC, store LIMIT 10")
def top_stores(spark, folder):
    return profile.top_by_count(retail.purchases(spark, folder), "store")


@query("top_products", ["purchases"], "SELECT product_name, count(*) AS n FROM purchases GROUP BY product_name ORDER BY n DESC, product_name LIMIT 10")
def top_products(spark, folder):
    return profile.top_by_count(retail.purchases(spark, folder), "product_name")


@query(
    "top_products_by_mean",
    ["purchases"],
    f"SELECT product_name, {single('avg(amount)')} AS mean, count(*) AS n FROM purchases GROUP BY product_name ORDER BY avg(amount) DESC, product_name LIMIT 10",
)
def top_products_by_mean(spark, folder):
    return rounded(profile.top_by_mean(retail.purchases(spark, folder), "product_name", "amount"), 4, mean=SINGLE)


HISTOGRAM = """SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(lo + bin * w, 4) AS "left", round(lo + (bin + 1) * w, 4) AS "right"
   FROM (SELECT least(floor((amount - lo) / w), 29) AS bin, lo, w FROM lines, (SELECT min(amount) AS lo, (max(amount) - min(amount)) / 30 AS w FROM lines)
         WHERE amount IS NOT NULL) GROUP BY bin, lo, w"""


@query("histogram", ["lines"], HISTOGRAM)
def histogram(spark, folder):
    return rounded(profile.histogram(retail.order_lines(spark, folder), "amount", 30), 4)


@query(
    "density",
    ["lines"],
    """SELECT CAST(i AS INT) AS point, round(lo + i * (hi - lo) / 39, 4) AS x,
       round(1e6 * sum(exp(-0.5 * pow((bonus_earned - (lo + i * ((hi - lo) / 39))) / h, 2))) / (n * h * sqrt(2 * pi())), 4) AS density
       FROM lines, (SELECT min(bonus_earned) AS lo, max(bonus_earned) AS hi, count(bonus_earned) AS n, stddev_samp(bonus_earned) * pow(count(bonus_earned), -0.2) AS h FROM lines), range(40) r(i)
       GROUP BY i, lo, hi, n, h""",
)
def density(spark, folder):
    table = profile.density(retail.order_lines(spark, folder), "bonus_earned")
    return rounded(table.withColumn("density", F.col("density") * 1e6), 4)


@query(
    "box_plot",
    ["lines"],
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3,
            round(CAST(min(CASE WHEN {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {c} END) AS DOUBLE), 6) AS whisker_low,
            round(CAST(max(CASE WHEN {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {c} END) AS DOUBLE), 6) AS whisker_high,
            count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers
            FROM lines, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM lines) GROUP BY q1, q2, q3"""
        for c in ("amount", "bonus_spent")
    ),
)
def box_plot(spark, folder):
    return rounded(profile.box_plot(retail.order_lines(spark, folder), ["amount", "bonus_spent"]))


WEEKDAYS = ",".join(f"({i},'{d}')" for i, d in enumerate(profile.WEEKDAYS))


@query(
    "weekday_counts",
    ["lines"],
    f"""SELECT CAST(position AS INT) AS position, weekday, n FROM (VALUES {WEEKDAYS}) v(position, weekday)
        LEFT JOIN (SELECT dayname(purchase_ts) AS weekday, count(*) AS n FROM lines GROUP BY 1) USING (weekday)""",
)
def weekday_counts(spark, folder):
    return profile.weekday_counts(retail.order_lines(spark, folder))


@query("month_day_counts", ["lines"], "SELECT CAST(day(purchase_ts) AS INT) AS day, count(*) AS n FROM lines GROUP BY 1")
def month_day_counts(spark, folder):
    return profile.month_day_counts(retail.order_lines(spark, folder))


@query("hour_counts", [], "SELECT CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1")
def hour_counts(spark, folder):
    return profile.hour_counts(retail.event_purchases(spark, folder))


@query("hour_counts_without_time", ["lines"], "SELECT CAST(0 AS INT) AS hour, count(*) AS n FROM lines GROUP BY 1 HAVING false")
def hour_counts_without_time(spark, folder):
    return profile.hour_counts(retail.order_lines(spark, folder))


@query(
    "correlation_matrix",
    ["lines"],
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lines" for a in NUMBERS for b in NUMBERS),
)
def correlation_matrix(spark, folder):
    return rounded(profile.correlation_matrix(retail.order_lines(spark, folder), NUMBERS))


@query(
    "strong_correlations",
    ["lines"],
    "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lines" for a in NUMBERS for b in NUMBERS)
    + ") WHERE abs(r) > 0.3",
)
def strong_correlations(spark, folder):
    return rounded(profile.strong_correlations(retail.order_lines(spark, folder), NUMBERS))


# every numeric column of the purchase lines, as the operator takes them by default
ALL_NUMBERS = ["client_id", "order_key", "line_number", "l_partkey", "l_suppkey", *NUMBERS, "l_extendedprice"]
ALL_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lines" for a in ALL_NUMBERS for b in ALL_NUMBERS)


@query("correlation_matrix_all", ["lines"], ALL_PAIRS)
def correlation_matrix_all(spark, folder):
    return rounded(profile.correlation_matrix(retail.order_lines(spark, folder)))


@query("strong_correlations_all", ["lines"], f"SELECT * FROM ({ALL_PAIRS}) WHERE abs(r) > 0.3")
def strong_correlations_all(spark, folder):
    return rounded(profile.strong_correlations(retail.order_lines(spark, folder)))


@query(
    "metric_pairs",
    ["cust"],
    """SELECT client_id, 'frequency~monetary' AS pair, CAST(frequency AS DOUBLE) AS x, round(monetary, 6) AS y FROM cust
       UNION ALL SELECT client_id, 'monetary~bonus_earned_sum', round(monetary, 6), round(bonus_earned_sum, 6) FROM cust""",
)
def metric_pairs(spark, folder):
    pairs = [("frequency", "monetary"), ("monetary", "bonus_earned_sum")]
    return rounded(profile.metric_pairs(stages.customers(spark, folder), pairs))


# --- missing values


@query(
    "fill_by_customer_median",
    ["part_filled"],
    f"SELECT client_id, order_key, line_number, part_key, {ts('card_date')} AS card_date, round(amount, 6) AS amount FROM part_filled",
)
def fill_by_customer_median(spark, folder):
    tx = stages.tx(spark, folder)
    filled = stages.cleaning(spark, folder).imputer.fill_by_customer(tx)
    return rounded(filled.select("client_id", "order_key", "line_number", "part_key", "card_date", "amount"))


@query(
    "fill_missing",
    ["filled"],
    f"""SELECT client_id, order_key, line_number, part_key, {ts('card_date')} AS card_date, round(amount, 6) AS amount, gender, store, card_store
        FROM filled""",
)
def fill_missing(spark, folder):
    df = stages.cleaning(spark, folder).filled
    return rounded(df.select("client_id", "order_key", "line_number", "part_key", "card_date", "amount", "gender", "store", "card_store"))


@query(
    "missing_before_after",
    ["tx", "filled"],
    """SELECT (SELECT sum(CAST(gender IS NULL AS INT) + CAST(card_store IS NULL AS INT) + CAST(store IS NULL AS INT) + CAST(amount IS NULL AS INT) + CAST(card_date IS NULL AS INT)) FROM tx)::BIGINT AS missing_before,
       (SELECT sum(CAST(gender IS NULL AS INT) + CAST(card_store IS NULL AS INT) + CAST(store IS NULL AS INT) + CAST(amount IS NULL AS INT) + CAST(card_date IS NULL AS INT)) FROM filled)::BIGINT AS missing_after""",
)
def missing_before_after(spark, folder):
    fitted = stages.cleaning(spark, folder)
    after = profile.missing_total(fitted.filled)
    return after.select(F.lit(fitted.imputer.missing_before).cast("long").alias("missing_before"), F.col("missing").alias("missing_after"))


@query(
    "modes",
    ["purchases"],
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c} AS value FROM (SELECT {c} FROM purchases WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""
        for c in ("gender", "store", "product_name")
    ),
)
def modes(spark, folder):
    found = impute.modes(retail.purchases(spark, folder), ["gender", "store", "product_name"])
    return spark.createDataFrame(list(found.items()), "column string, value string")


@query(
    "fill_means",
    ["purchases"],
    "SELECT order_key, line_number, part_key, round(coalesce(amount, (SELECT avg(amount) FROM purchases)), 4) AS amount FROM purchases",
)
def fill_means(spark, folder):
    df = impute.fill_means(retail.purchases(spark, folder), ["amount"])
    return rounded(df.select("order_key", "line_number", "part_key", "amount"), 4)


@query(
    "fill_placeholders",
    ["purchases"],
    "SELECT order_key, line_number, part_key, round(coalesce(amount, 1500), 4) AS amount, CAST(0.5 AS DOUBLE) AS recency_ratio FROM purchases",
)
def fill_placeholders(spark, folder):
    df = impute.fill_placeholders(retail.purchases(spark, folder), {"amount": 1500, "recency_ratio": 0.5})
    return rounded(df.select("order_key", "line_number", "part_key", "amount", "recency_ratio"), 4)


# --- outliers


@query(
    "outlier_fences",
    ["filled", "fences"],
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round({low(c)}, 4) AS low, round({high(c)}, 4) AS high, count(*) FILTER ({c} < {low(c)} OR {c} > {high(c)}) AS outliers,
            count(*) AS n_rows, round(count(*) FILTER ({c} < {low(c)} OR {c} > {high(c)}) * 100.0 / count(*), 6) AS percent FROM filled, fences GROUP BY ALL"""
        for c in schema.OUTLIER_COLUMNS
    ),
)
def outlier_fences(spark, folder):
    fitted = stages.cleaning(spark, folder)
    return rounded(scaling.count_outliers(fitted.filled, fitted.fences), 6, low=4, high=4)


@query(
    "winsorised",
    ["cut"],
    "SELECT client_id, order_key, line_number, part_key, " + ", ".join(f"round({c}, 4) AS {c}" for c in schema.OUTLIER_COLUMNS if c != "avg_check") + " FROM cut",
)
def winsorised(spark, folder):
    fitted = stages.cleaning(spark, folder)
    df = scaling.winsorise(fitted.filled, fitted.fences)
    return rounded(df.select("client_id", "order_key", "line_number", "part_key", *[c for c in schema.OUTLIER_COLUMNS if c != "avg_check"]), 4)


@query(
    "exact_quantiles",
    ["lines"],
    """SELECT p AS probability, round(amount, 6) AS amount, round(bonus_spent, 6) AS bonus_spent FROM
       (SELECT unnest([0.01, 0.1, 0.5, 0.9, 0.99])::DOUBLE AS p, unnest(quantile_cont(amount, [0.01, 0.1, 0.5, 0.9, 0.99])) AS amount,
        unnest(quantile_cont(bonus_spent, [0.01, 0.1, 0.5, 0.9, 0.99])) AS bonus_spent FROM lines)""",
)
def quantiles(spark, folder):
    shares = [0.01, 0.1, 0.5, 0.9, 0.99]
    found = exact_quantiles(retail.order_lines(spark, folder), ["amount", "bonus_spent"], shares)
    rows = list(zip(shares, found["amount"], found["bonus_spent"]))
    return rounded(spark.createDataFrame(rows, "probability double, amount double, bonus_spent double"))


# --- scaling and encoding


@query(
    "scaled",
    ["scaled"],
    "SELECT client_id, order_key, line_number, part_key, " + ", ".join(f"round({c}, 6) AS {c}" for c in [*schema.MONEY_COLUMNS, *schema.RATE_COLUMNS]) + " FROM scaled",
)
def scaled(spark, folder):
    df = stages.clean(spark, folder)
    return rounded(df.select("client_id", "order_key", "line_number", "part_key", *schema.MONEY_COLUMNS, *schema.RATE_COLUMNS))


@query("label_codes", ["enc"], "SELECT gender, gender_code, count(*) AS n FROM enc GROUP BY 1, 2")
def label_codes(spark, folder):
    return stages.clean(spark, folder).groupBy("gender", "gender_code").agg(F.count(F.lit(1)).alias("n"))


@query("store_flags", ["enc"], "SELECT location, count(*) AS n FROM enc GROUP BY 1")
def store_flags(spark, folder):
    df = stages.clean(spark, folder)
    names = stages.cleaning(spark, folder).encoder.store_columns
    return df.unpivot([], names, "location", "flag").filter("flag = 1").groupBy("location").agg(F.count(F.lit(1)).alias("n"))


@query("product_categories", ["enc"], "SELECT product_category, product_name, count(*) AS n FROM enc GROUP BY 1, 2")
def product_categories(spark, folder):
    return stages.clean(spark, folder).groupBy("product_category", "product_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "category_flags",
    ["enc"],
    " UNION ALL ".join(f"SELECT 'product_{c}' AS flag, count(*) FILTER (product_category = '{c}') AS n FROM enc" for c in PRODUCT_CATEGORIES),
)
def category_flags(spark, folder):
    df = stages.clean(spark, folder)
    names = stages.cleaning(spark, folder).encoder.product_columns
    return df.unpivot([], names, "flag", "value").groupBy("flag").agg(F.sum("value").alias("n"))


@query(
    "number_coercion",
    [],
    "SELECT o_orderkey, coalesce(TRY_CAST(o_orderstatus AS DOUBLE), 1) AS from_text, round(coalesce(TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE), 0), 4) AS from_number FROM orders",
)
def number_coercion(spark, folder):
    orders = retail.table(spark, folder, "orders")
    return rounded(
        orders.select(
            "o_orderkey", encode.to_number(F.col("o_orderstatus"), 1).alias("from_text"), encode.to_number(F.col("o_totalprice"), 0).alias("from_number")
        ),
        4,
    )


assert OTHER == encode.OTHER_PRODUCT
