"""Customer aggregates, RFM, features, clusters, score, and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import stages
from checks.registry import SINGLE, query, rounded, single, ts
from checks.sql import SEGMENT_NAMES, categories_case, days
from retentio.operators import categories, clusters, customers, loyalty, profile, rfm
from retentio.plans.stages import fit_loyalty
from retentio.sources import retail

# --- customer aggregates


@query(
    "customer_aggregates",
    ["cust"],
    f"""SELECT client_id, frequency, round(monetary, 6) AS monetary, round(avg_purchase, 6) AS avg_purchase, round(amount_std, 6) AS amount_std,
        {ts('first_ts')} AS first_ts, {ts('last_ts')} AS last_ts, round(bonus_earned_sum, 6) AS bonus_earned_sum, round(bonus_earned_mean, 6) AS bonus_earned_mean,
        round(bonus_spent_sum, 6) AS bonus_spent_sum, round(bonus_spent_mean, 6) AS bonus_spent_mean, gender_code, product_category, recency, activity_period,
        round(bonus_usage_ratio, 6) AS bonus_usage_ratio, round(purchase_frequency, 6) AS purchase_frequency FROM cust""",
)
def customer_aggregates(spark, folder):
    df = stages.customers(spark, folder)
    return rounded(df.select(*[c for c in df.columns if not c.startswith(("location_", "product_")) or c == "product_category"]))


@query("store_shares", ["location_shares"], "SELECT client_id, location, round(share, 6) AS share FROM location_shares")
def store_shares(spark, folder):
    names = stages.cleaning(spark, folder).encoder.store_columns
    df = stages.customers(spark, folder).unpivot(["client_id"], names, "location", "share")
    return rounded(df.filter("share > 0"))


@query("category_shares", ["product_shares"], "SELECT client_id, 'product_' || category AS category, round(share, 6) AS share FROM product_shares")
def category_shares(spark, folder):
    names = stages.cleaning(spark, folder).encoder.product_columns
    df = stages.customers(spark, folder).unpivot(["client_id"], names, "category", "share")
    return rounded(df.filter("share > 0"))


@query(
    "any_aggregates",
    ["lines"],
    f"""SELECT client_id, {single('avg(amount)')} AS amount_mean, round(sum(amount), 2) AS amount_sum, round(avg(quantity), 6) AS quantity_mean, CAST(sum(quantity) AS BIGINT) AS quantity_sum,
       first(o_orderpriority ORDER BY purchase_ts, order_key, line_number, o_orderpriority) AS o_orderpriority_first
       FROM (SELECT client_id, amount, quantity, o_orderpriority, purchase_ts, order_key, line_number FROM lines) GROUP BY client_id""",
)
def any_aggregates(spark, folder):
    lines = retail.order_lines(spark, folder).select("client_id", "amount", "quantity", "o_orderpriority", "purchase_ts", "order_key", "line_number")
    df = customers.aggregate_anything(lines, order=["purchase_ts", "order_key", "line_number"])
    keep = ["client_id", "amount_mean", "amount_sum", "quantity_mean", "quantity_sum", "o_orderpriority_first"]
    return rounded(df.select(*keep), 6, amount_mean=SINGLE, amount_sum=2)


EXPLORED = f"""SELECT client_id, {days('now_ts', 'last_ts')} AS recency, frequency, monetary, avg_purchase,
    greatest(1, {days('last_ts', 'first_ts')}) AS activity_period, total_bonus_earned, total_bonus_used
    FROM (SELECT client_id, count(amount) AS frequency, sum(amount) AS monetary, avg(amount) AS avg_purchase, min(purchase_ts) AS first_ts, max(purchase_ts) AS last_ts,
          sum(bonus_earned) AS total_bonus_earned, sum(bonus_spent) AS total_bonus_used FROM purchases GROUP BY client_id),
         (SELECT max(purchase_ts) AS now_ts FROM purchases)"""


@query(
    "explored_customers",
    ["purchases"],
    f"""SELECT client_id, recency, frequency, round(monetary, 2) AS monetary, {single('avg_purchase')} AS avg_purchase, CAST(activity_period AS BIGINT) AS activity_period,
        round(total_bonus_earned, 4) AS total_bonus_earned, round(total_bonus_used, 4) AS total_bonus_used FROM ({EXPLORED})""",
)
def explored_customers(spark, folder):
    df = customers.explore_customers(retail.purchases(spark, folder))
    return rounded(df, 4, monetary=2, avg_purchase=SINGLE)


@query(
    "event_customers",
    [],
    f"""SELECT user_id AS client_id, count(value) AS frequency, round(sum(value), 2) AS monetary, CAST(greatest(0, {days('max(now_ts)', 'max(ts)')}) AS BIGINT) AS recency,
        CAST(greatest(1, {days('max(ts)', 'min(ts)')}) AS BIGINT) AS activity_period
        FROM events, (SELECT max(ts) AS now_ts FROM events WHERE event_type = 'purchase') WHERE event_type = 'purchase' GROUP BY user_id""",
)
def event_customers(spark, folder):
    """Times of day: recency counts complete 24-hour days."""
    df = customers.aggregate_customers(retail.event_purchases(spark, folder))
    return rounded(df.select("client_id", "frequency", "monetary", "recency", "activity_period"), 2)


# --- RFM


@query(
    "segment_overview",
    ["overview"],
    f"""SELECT loyalty_segment, round(avg(recency), 4) AS mean_recency, round(avg(frequency), 4) AS mean_frequency, {single('avg(monetary)')} AS mean_monetary,
        {single('avg(avg_purchase)')} AS mean_avg_purchase, count(*) AS n FROM overview GROUP BY loyalty_segment""",
)
def segment_overview(spark, folder):
    """Flagship: purchases -> customers -> RFM -> segments."""
    table = customers.aggregate_customers(retail.order_lines(spark, folder).select("client_id", "amount", "purchase_ts"))
    scored = rfm.apply_rfm(table, rfm.fit_cuts(table))
    return rounded(rfm.segment_statistics(scored), 4, mean_monetary=SINGLE, mean_avg_purchase=SINGLE)


@query(
    "rfm_cuts",
    ["cuts"],
    " UNION ALL ".join(f"SELECT '{m}' AS metric, round({m}_1, 6) AS q25, round({m}_2, 6) AS q50, round({m}_3, 6) AS q75 FROM cuts" for m in rfm.METRICS),
)
def rfm_cuts(spark, folder):
    cuts = rfm.fit_cuts(stages.customers(spark, folder))
    return rounded(spark.createDataFrame([(m, *v) for m, v in cuts.items()], "metric string, q25 double, q50 double, q75 double"))


RFM_COLUMNS = ["client_id", "R", "F", "M", "rfm_group", "rfm_score", "loyalty_segment"]


@query("rfm_scores", ["rfm1"], f"SELECT {', '.join(RFM_COLUMNS)} FROM rfm1")
def rfm_scores(spark, folder):
    df = stages.customers(spark, folder)
    return rfm.apply_rfm(df, rfm.fit_cuts(df)).select(*RFM_COLUMNS)


@query("rfm_two_pass", ["rfm"], f"SELECT {', '.join(RFM_COLUMNS)} FROM rfm")
def rfm_two_pass(spark, folder):
    return stages.rfm_customers(spark, folder).select(*RFM_COLUMNS)


@query(
    "rfm_explored",
    ["rfm1"],
    """SELECT client_id, rfm_score, CASE WHEN rfm_score >= 10 THEN 'Высоколояльные' WHEN rfm_score >= 8 THEN 'Умеренно лояльные' WHEN rfm_score >= 6 THEN 'Низколояльные'
       WHEN rfm_score >= 4 THEN 'Потенциально лояльные' ELSE 'Группа оттока' END AS loyalty_segment FROM rfm1""",
)
def rfm_explored(spark, folder):
    return rfm.explore_rfm(stages.customers(spark, folder)).select("client_id", "rfm_score", "loyalty_segment")


@query("rfm_score_distribution", ["rfm"], "SELECT rfm_score, count(*) AS n FROM rfm GROUP BY rfm_score")
def rfm_score_distribution(spark, folder):
    return profile.value_counts(stages.rfm_customers(spark, folder), "rfm_score")


@query(
    "segment_profile",
    ["rfm"],
    """SELECT loyalty_segment, round(avg(recency), 4) AS mean_recency, round(avg(frequency), 4) AS mean_frequency, round(avg(monetary), 4) AS mean_monetary,
       round(avg(avg_purchase), 4) AS mean_avg_purchase, count(*) AS n FROM rfm GROUP BY loyalty_segment""",
)
def segment_profile(spark, folder):
    return rounded(rfm.segment_statistics(stages.rfm_customers(spark, folder)), 4)


@query(
    "ordered_segments",
    ["rfm"],
    """SELECT CAST(position AS INT) AS position, loyalty_segment, n FROM (VALUES (0,'Высоколояльные'),(1,'Лояльные'),(2,'Умеренно лояльные'),(3,'Низколояльные'),(4,'Отток')) v(position, loyalty_segment)
       LEFT JOIN (SELECT loyalty_segment, count(*) AS n FROM rfm GROUP BY 1) USING (loyalty_segment)""",
)
def ordered_segments(spark, folder):
    return rfm.ordered_segments(stages.rfm_customers(spark, folder))


SPARSE = """SELECT client_id, count(amount) AS frequency, avg(amount) FILTER (quantity > 44) AS mean_large, avg(amount) FILTER (quantity = 7) AS mean_seven FROM lines GROUP BY client_id"""


def _with_gaps(spark, folder):
    lines = retail.order_lines(spark, folder)
    return lines.groupBy("client_id").agg(
        F.count("amount").alias("frequency"),
        F.avg(F.when(F.col("quantity") > 44, F.col("amount"))).alias("mean_large"),
        F.avg(F.when(F.col("quantity") == 7, F.col("amount"))).alias("mean_seven"),
    )


@query(
    "sparse_columns",
    ["lines"],
    f"""SELECT 'mean_large' AS "column" FROM ({SPARSE}) HAVING avg(CAST(mean_large IS NULL AS INT)) > 0.3
        UNION ALL SELECT 'mean_seven' FROM ({SPARSE}) HAVING avg(CAST(mean_seven IS NULL AS INT)) > 0.3""",
)
def sparse_columns(spark, folder):
    return spark.createDataFrame([(c,) for c in rfm.sparse_columns(_with_gaps(spark, folder))], "column string")


@query("complete_customers", ["lines"], f"SELECT client_id, frequency, {single('mean_large')} AS mean_large FROM ({SPARSE}) WHERE mean_large IS NOT NULL")
def complete_customers(spark, folder):
    """Without the RFM columns only the sparse column and incomplete rows are dropped."""
    return rounded(rfm.prepare_customers(_with_gaps(spark, folder)), 2, mean_large=SINGLE)


# --- engineered features

FEATURES = ["bonus_earning_ratio", "bonus_activity", "recency_ratio", "purchase_density", "amount_cv", "purchase_stability", "weighted_rfm"]


@query("loyalty_features", ["feat"], "SELECT client_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + " FROM feat")
def loyalty_features(spark, folder):
    return rounded(stages.features(spark, folder).select("client_id", *FEATURES))


DIVERSITY = ["product_diversity", "product_categories", "product_gini", "location_loyalty", "location_diversity"]


@query(
    "diversity_features",
    ["diversity"],
    """SELECT client_id, round(product_diversity, 6) AS product_diversity, product_categories, round(product_gini, 9) + 0.0 AS product_gini,
       round(location_loyalty, 6) AS location_loyalty, location_diversity FROM diversity""",
)
def diversity_features(spark, folder):
    df = loyalty.add_features(stages.rfm_customers(spark, folder), parity=False)
    return rounded(df.select("client_id", *DIVERSITY), 6, product_gini=9).withColumn("product_gini", F.col("product_gini") + 0.0)


# --- clusters (a given grouping for the twins, k-means for the rest)


@query(
    "cluster_ranking",
    ["rfm"],
    """SELECT rfm_score AS cluster, round(recency_rank, 1) AS recency_rank, round(frequency_rank, 1) AS frequency_rank, round(monetary_rank, 1) AS monetary_rank, total_rank,
       CAST(position AS INT) AS position, CASE WHEN position <= 5 THEN (['Высоколояльные','Лояльные','Умеренно лояльные','Низколояльные','Отток'])[position] ELSE 'Сегмент ' || position END AS cluster_segment, n
       FROM (SELECT *, row_number() OVER (ORDER BY total_rank, rfm_score) AS position FROM (SELECT *, recency_rank + frequency_rank + monetary_rank AS total_rank FROM
         (SELECT *, CAST(rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2 AS DOUBLE) AS recency_rank,
          CAST(rank() OVER (ORDER BY f DESC) + (count(*) OVER (PARTITION BY f) - 1) / 2 AS DOUBLE) AS frequency_rank,
          CAST(rank() OVER (ORDER BY m DESC) + (count(*) OVER (PARTITION BY m) - 1) / 2 AS DOUBLE) AS monetary_rank
          FROM (SELECT rfm_score, avg(recency) AS r, avg(frequency) AS f, avg(monetary) AS m, count(*) AS n FROM rfm GROUP BY rfm_score))))""",
)
def cluster_ranking(spark, folder):
    df = stages.rfm_customers(spark, folder).withColumn("cluster", F.col("rfm_score"))
    ranked = clusters.rank_clusters(clusters.cluster_profile(df))
    keep = ["cluster", "recency_rank", "frequency_rank", "monetary_rank", "total_rank", "position", "cluster_segment", "n"]
    return rounded(ranked.select(*keep), 1)


@query("standardised_features", ["feat"], """SELECT client_id, round((frequency - avg(frequency) OVER ()) / stddev_pop(frequency) OVER (), 6) AS frequency,
   round((recency - avg(recency) OVER ()) / stddev_pop(recency) OVER (), 6) AS recency, round((amount_cv - avg(amount_cv) OVER ()) / stddev_pop(amount_cv) OVER (), 6) AS amount_cv FROM feat""")
def standardised_features(spark, folder):
    names = ["frequency", "recency", "amount_cv"]
    df = stages.features(spark, folder)
    values = clusters.fit_standardiser(df, names).values()
    return rounded(df.select("client_id", *[v.alias(n) for v, n in zip(values, names)]))


@query("kmeans_clusters")
def kmeans_clusters(spark, folder):
    """Segment sizes of k-means with five clusters."""
    df = stages.features(spark, folder)
    fitted = clusters.fit_clusters(df, k=5, starts=2)
    return fitted.apply(df).groupBy("cluster", "cluster_segment").agg(F.count(F.lit(1)).alias("n"))


@query("kmeans_fixed_point", ["feat"], "SELECT count(*) AS customers, 5::BIGINT AS clusters, 0::BIGINT AS centres_off FROM feat")
def kmeans_fixed_point(spark, folder):
    """Ten starts run to the end: every customer has a cluster, every centre is the mean of its members."""
    df = stages.features(spark, folder)
    fitted = clusters.fit_clusters(df, k=5)
    placed = fitted.apply(df)
    means = [F.avg(v).alias(f"m{i}") for i, v in enumerate(fitted.standardiser.values())]
    rows = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *means)
    off = F.lit(False)
    for c, centre in enumerate(fitted.centres):
        for i, x in enumerate(centre):
            off = off | ((F.col("cluster") == c) & (F.abs(F.col(f"m{i}") - F.lit(float(x))) > 0.05))
    return rows.agg(
        F.sum("n").alias("customers"), F.count(F.lit(1)).alias("clusters"), F.count_if(off).alias("centres_off")
    )


@query("component_correlations", ["feat"], "SELECT count(*) AS customers, 0::BIGINT AS correlated, true AS falling FROM feat")
def component_correlations(spark, folder):
    """Components are uncorrelated and their variances fall."""
    df = stages.features(spark, folder)
    made = clusters.fit_projection(df).apply(df)
    a, b, c = (F.col(f"pca_component_{i}") for i in (1, 2, 3))
    pairs = [F.abs(F.corr(x, y)) > 1e-6 for x, y in ((a, b), (a, c), (b, c))]
    count = sum((p.cast("long") for p in pairs[1:]), pairs[0].cast("long"))
    falling = (F.var_pop(a) >= F.var_pop(b)) & (F.var_pop(b) >= F.var_pop(c))
    return made.agg(F.count(F.lit(1)).alias("customers"), count.alias("correlated"), falling.alias("falling"))


@query("kmeans_choice_of_k")
def kmeans_choice_of_k(spark, folder):
    df = stages.features(spark, folder)
    # every k that the operator tries and all its starts; not persisted, as in fit_clusters
    _, scores = clusters.choose_k(df.select(clusters.fit_standardiser(df).vector().alias("_x")))
    return spark.createDataFrame([(k, float(s)) for k, s in scores.items()], "k int, silhouette double")


@query("principal_components")
def principal_components(spark, folder):
    df = stages.features(spark, folder)
    fitted = clusters.fit_projection(df)
    return rounded(fitted.apply(df).select("client_id", *[f"pca_component_{i}" for i in (1, 2, 3)]))


@query("loyalty_stage")
def loyalty_stage(spark, folder):
    """The whole loyalty stage in one call: features, clusters, components, score, target."""
    table, _ = fit_loyalty(stages.rfm_customers(spark, folder), starts=1)
    return table.groupBy("cluster_segment", "loyalty_category", "loyalty_target").agg(F.count(F.lit(1)).alias("n"))


# --- score and categories


@query("loyalty_score", ["scored_raw", "scored_unit"], """SELECT client_id, round(r.loyalty_score, 6) AS raw, round(u.loyalty_score, 6) AS unit
   FROM scored_raw r JOIN scored_unit u USING (client_id)""")
def loyalty_score(spark, folder):
    df = stages.features(spark, folder)
    return rounded(df.select("client_id", loyalty.score_expression(df, "raw").alias("raw"), loyalty.score_expression(df, "unit").alias("unit")))


@query("loyalty_categories", ["cat_raw", "cat_unit"], """SELECT client_id, r.loyalty_category AS raw, u.loyalty_category AS unit
   FROM cat_raw r JOIN cat_unit u USING (client_id)""")
def loyalty_categories(spark, folder):
    raw = stages.categorised(spark, folder, "raw").select("client_id", F.col("loyalty_category").alias("raw"))
    unit = stages.categorised(spark, folder, "unit").select("client_id", F.col("loyalty_category").alias("unit"))
    return raw.join(unit, "client_id")


@query(
    "category_boundaries",
    ["bounds_raw", "bounds_unit"],
    "SELECT 'raw' AS scale, round(b1, 6) AS b1, round(b2, 6) AS b2, round(b3, 6) AS b3, round(b4, 6) AS b4 FROM bounds_raw UNION ALL SELECT 'unit', round(b1, 6), round(b2, 6), round(b3, 6), round(b4, 6) FROM bounds_unit",
)
def category_boundaries(spark, folder):
    rows = [(s, *stages.boundaries(spark, folder, s)[1:5]) for s in ("raw", "unit")]
    return rounded(spark.createDataFrame(rows, "scale string, b1 double, b2 double, b3 double, b4 double"))


@query(
    "categories_equal_width",
    ["scored_unit"],
    f"SELECT loyalty_category, count(*) AS n FROM (SELECT {categories_case('loyalty_score', ['0', '0.2', '0.4', '0.6000000000000001', '0.8', '1'])} AS loyalty_category FROM scored_unit) GROUP BY 1",
)
def categories_equal_width(spark, folder):
    df = stages.scored(spark, folder)
    cut = categories.categorise(df, categories.fit_boundaries(df, "equal_width"))
    return cut.groupBy("loyalty_category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "categories_manual",
    ["scored_unit"],
    f"SELECT loyalty_category, count(*) AS n FROM (SELECT {categories_case('loyalty_score', ['0', '0.3', '0.3', '0.5', '0.75', '1'])} AS loyalty_category FROM scored_unit) GROUP BY 1",
)
def categories_manual(spark, folder):
    df = stages.scored(spark, folder)
    cut = categories.categorise(df, categories.fit_boundaries(df, "manual", custom=[0, 0.3, 0.3, 0.5, 0.75, 1]))
    return cut.groupBy("loyalty_category").agg(F.count(F.lit(1)).alias("n"))


@query("categories_kmeans")
def categories_kmeans(spark, folder):
    df = stages.scored(spark, folder)
    cut = categories.categorise(df, categories.fit_boundaries(df, "kmeans"))
    return cut.groupBy("loyalty_category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "category_balance",
    ["cat_raw"],
    """SELECT CAST(sum(n) AS BIGINT) AS clients, count(*) AS categories, round(max(n) / min(n), 6) AS imbalance, round(-sum(p * log2(p)), 6) AS entropy,
       round(-sum(p * log2(p)) / log2(count(*)), 6) AS normalized_entropy, -sum(p * log2(p)) / log2(count(*)) > 0.8 AS is_balanced
       FROM (SELECT n, n / sum(n) OVER () AS p FROM (SELECT loyalty_category, count(*) AS n FROM cat_raw GROUP BY 1))""",
)
def category_balance(spark, folder):
    return rounded(categories.evaluate_distribution(stages.categorised(spark, folder, "raw")))


@query("category_counts", ["cat_unit"], "SELECT loyalty_category, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM cat_unit GROUP BY 1")
def category_counts(spark, folder):
    return rounded(categories.category_counts(stages.categorised(spark, folder)))


PROFILED = ["recency", "frequency", "monetary", "avg_purchase", "bonus_usage_ratio", "bonus_earning_ratio", "bonus_activity", "recency_ratio", "purchase_density", "activity_period", "purchase_stability"]


@query(
    "category_profiles",
    ["cat_unit"],
    "SELECT loyalty_category, " + ", ".join(f"round(avg({m}), 4) AS {m}" for m in PROFILED) + ", count(*) AS size, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM cat_unit GROUP BY 1",
)
def category_profiles(spark, folder):
    return rounded(categories.category_profiles(stages.categorised(spark, folder)), 4)


@query(
    "optimised_boundaries",
    ["scored_unit"],
    """SELECT i, round(s, 2) AS boundary FROM (SELECT loyalty_score AS s, row_number() OVER (ORDER BY loyalty_score) - 1 AS rn, count(*) OVER () AS n FROM scored_unit),
       (VALUES (1, 15), (2, 35), (3, 60), (4, 85)) v(i, c) WHERE rn = n * c // 100""",
)
def optimised_boundaries(spark, folder):
    found = categories.optimise_boundaries(stages.scored(spark, folder), [15, 20, 25, 25, 15])
    return spark.createDataFrame([(i, found[i]) for i in range(1, 5)], "i int, boundary double")


@query("segment_agreement", ["cat_raw"], "SELECT round(avg(CAST(loyalty_category = loyalty_segment AS INT)) * 100, 6) AS percent FROM cat_raw")
def segment_agreement(spark, folder):
    return rounded(categories.agreement(stages.categorised(spark, folder, "raw")))


@query(
    "transition_matrix",
    ["cat_unit"],
    "SELECT loyalty_segment, " + ", ".join(f"round(count(*) FILTER (loyalty_category = '{n}') / count(*), 6) AS \"{n}\"" for n in SEGMENT_NAMES) + " FROM cat_unit GROUP BY 1",
)
def transition_matrix(spark, folder):
    return rounded(categories.transition_matrix(stages.rfm_customers(spark, folder), stages.categorised(spark, folder)))


@query(
    "normalised_profiles",
    ["cat_unit"],
    """SELECT loyalty_category, metric, round(mean, 4) AS mean, round(CASE WHEN max(mean) OVER w > min(mean) OVER w THEN (mean - min(mean) OVER w) / (max(mean) OVER w - min(mean) OVER w) ELSE 0 END, 4) AS scaled
       FROM (UNPIVOT (SELECT loyalty_category, """
    + ", ".join(f"CAST(avg({m}) AS DOUBLE) AS {m}" for m in PROFILED[:8])
    + " FROM cat_unit GROUP BY 1) ON COLUMNS(* EXCLUDE loyalty_category) INTO NAME metric VALUE mean) WINDOW w AS (PARTITION BY metric)",
)
def normalised_profiles(spark, folder):
    return rounded(categories.normalised_profiles(stages.categorised(spark, folder)), 4)


@query(
    "score_density_by_category",
    ["cat_unit"],
    """SELECT loyalty_category, CAST(i AS INT) AS point, round(lo + i * (hi - lo) / 9, 5) AS x,
       round(sum(exp(-0.5 * pow((loyalty_score - (lo + i * ((hi - lo) / 9))) / h, 2))) / (n * h * sqrt(2 * pi())), 5) AS density
       FROM cat_unit JOIN (SELECT loyalty_category, min(loyalty_score) AS lo, max(loyalty_score) AS hi, count(*) AS n, stddev_samp(loyalty_score) * pow(count(*), -0.2) AS h
            FROM cat_unit GROUP BY 1 HAVING stddev_samp(loyalty_score) > 0) USING (loyalty_category), range(10) r(i) GROUP BY loyalty_category, i, lo, hi, n, h""",
)
def score_density_by_category(spark, folder):
    return rounded(profile.density(stages.categorised(spark, folder), "loyalty_score", 10, by="loyalty_category"), 5)


@query(
    "before_after_counts",
    ["rfm", "cat_unit"],
    """SELECT coalesce(a.c, b.c) AS class, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after FROM (SELECT loyalty_segment AS c, count(*) AS n FROM rfm GROUP BY 1) a
       FULL OUTER JOIN (SELECT loyalty_category AS c, count(*) AS n FROM cat_unit GROUP BY 1) b ON a.c = b.c""",
)
def before_after_counts(spark, folder):
    return categories.before_after_counts(stages.rfm_customers(spark, folder), stages.categorised(spark, folder), "loyalty_segment", "loyalty_category")
