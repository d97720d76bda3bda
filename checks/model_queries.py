"""Targets, balancing, splits, importance, models, evaluation, and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import stages
from checks.registry import SINGLE, query, rounded, single
from checks.sql import FIVE_CASE, categories_case, days, hash_key
from retentio.models import training
from retentio.models.classifiers import Spec, base_specs, custom_spec
from retentio.operators import evaluation as ev
from retentio.operators import importance as imp
from retentio.operators import sampling
from retentio.plans import scoring
from retentio.plans.run import train_models
from retentio.plans.serving import fit_serving
from retentio.plans.stages import Loyalty, assemble, prepare_model_data
from retentio.operators.clusters import fit_clusters, fit_projection
from retentio.session import materialize, scratch_path

# Small settings: these entries show that every model trains; sizes are free parameters.
SMALL = {
    "logistic_regression": {"maxIter": 20},
    "random_forest": {"numTrees": 10, "maxDepth": 5},
    "gradient_boosting": {"maxIter": 5},
    "xgboost": {"maxIter": 5},
    "lightgbm": {"maxIter": 5},
    "svm": {"maxIter": 10},
}
FEATURES = ["recency", "frequency", "monetary", "avg_purchase", "bonus_earning_ratio", "recency_ratio", "purchase_density", "amount_cv", "activity_period"]
QUICK = custom_spec("logistic", maxIter=10)


def _labelled(spark, folder, scale="raw"):
    """Customers with a feature vector, label, and exact stratified split."""

    def make():
        df = stages.targeted(spark, folder, scale).select("client_id", "last_ts", "loyalty_target", *FEATURES)
        return materialize(sampling.split(assemble(df, FEATURES, "loyalty_target"), "label"), "labelled")

    return stages._once(spark, folder, f"labelled-{scale}", make)


def _parts(spark, folder, scale="raw"):
    df = _labelled(spark, folder, scale)
    return df.filter("split = 'train'"), df.filter("split = 'test'")


# --- target, weights, splits


@query("loyalty_target", ["target_raw", "target_unit"], "SELECT client_id, r.loyalty_target AS two, u.loyalty_target AS four FROM target_raw r JOIN target_unit u USING (client_id)")
def loyalty_target(spark, folder):
    two = stages.targeted(spark, folder, "raw").select("client_id", F.col("loyalty_target").alias("two"))
    return two.join(stages.targeted(spark, folder).select("client_id", F.col("loyalty_target").alias("four")), "client_id")


@query("unmapped_target", ["cat_unit"], "SELECT count(*) FILTER (loyalty_category NOT IN ('Отток', 'Высоколояльные')) AS unmapped, count(*) AS n_rows FROM cat_unit")
def unmapped_target(spark, folder):
    return sampling.unmapped(sampling.add_target(stages.categorised(spark, folder), sampling.EXTREMES))


@query("class_imbalance", ["target_unit"], "SELECT round(max(n) / min(n), 6) AS imbalance FROM (SELECT count(*) AS n FROM target_unit GROUP BY loyalty_target)")
def class_imbalance(spark, folder):
    return rounded(sampling.imbalance(stages.targeted(spark, folder), "loyalty_target"))


@query("class_weights", ["target_unit"], "SELECT loyalty_target, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM (SELECT loyalty_target, count(*) AS n FROM target_unit GROUP BY 1)")
def class_weights(spark, folder):
    return rounded(sampling.class_weights(stages.targeted(spark, folder), "loyalty_target"))


ALLOCATION = """SELECT y, CAST(base + CAST(row_number() OVER (ORDER BY rem DESC, y) <= T - sum(base) OVER () AS INT) AS BIGINT) AS take
    FROM (SELECT y, floor(n * T / total) AS base, n * T / total - floor(n * T / total) AS rem, T FROM (SELECT loyalty_target AS y, count(*) AS n FROM target_unit GROUP BY 1),
          (SELECT count(*) AS total, ceil(count(*) * 0.2) AS T FROM target_unit))"""
SPLIT = f"""SELECT client_id, loyalty_target, CASE WHEN row_number() OVER (PARTITION BY loyalty_target ORDER BY {hash_key(42, 'client_id')}) <= take THEN 'test' ELSE 'train' END AS split
    FROM target_unit JOIN ({ALLOCATION}) a ON loyalty_target = a.y"""


@query("stratified_split", ["target_unit"], SPLIT)
def stratified_split(spark, folder):
    return sampling.split(stages.targeted(spark, folder), "loyalty_target").select("client_id", "loyalty_target", "split")


@query(
    "plain_split",
    ["target_unit"],
    f"SELECT client_id, CASE WHEN row_number() OVER (ORDER BY {hash_key(42, 'client_id')}) <= (SELECT ceil(count(*) * 0.3) FROM target_unit) THEN 'test' ELSE 'train' END AS split FROM target_unit",
)
def plain_split(spark, folder):
    return sampling.split(stages.targeted(spark, folder), None, 0.3).select("client_id", "split")


@query("split_shares", ["target_unit"], f"SELECT split, loyalty_target, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split), 6) AS percent FROM ({SPLIT}) GROUP BY 1, 2")
def split_shares(spark, folder):
    return rounded(sampling.class_shares(sampling.split(stages.targeted(spark, folder), "loyalty_target"), "loyalty_target"))


@query(
    "stratified_folds",
    ["target_unit"],
    f"""SELECT client_id, CAST(CASE WHEN rn < r * (q + 1) THEN rn // (q + 1) ELSE r + (rn - r * (q + 1)) // q END AS INT) AS fold
        FROM (SELECT client_id, row_number() OVER (PARTITION BY loyalty_target ORDER BY {hash_key(42, 'client_id')}) - 1 AS rn,
              count(*) OVER (PARTITION BY loyalty_target) // 5 AS q, count(*) OVER (PARTITION BY loyalty_target) % 5 AS r FROM target_unit)""",
)
def stratified_folds(spark, folder):
    return sampling.folds(stages.targeted(spark, folder), "loyalty_target", 5).select("client_id", "fold")


@query(
    "time_blocks",
    ["rfm"],
    "SELECT client_id, CAST("
    + " + ".join(f"CAST(rn >= n * {i + 1} // 6 AS INT)" for i in range(5))
    + f" AS INT) AS block FROM (SELECT client_id, row_number() OVER (ORDER BY last_ts, {hash_key(42, 'client_id')}) - 1 AS rn, count(*) OVER () AS n FROM rfm)",
)
def time_blocks(spark, folder):
    return sampling.time_folds(stages.rfm_customers(spark, folder), "last_ts", 5).select("client_id", "block")


# --- balancing

INDEXED = f"""SELECT *, loyalty_target AS y, row_number() OVER (PARTITION BY loyalty_target ORDER BY {hash_key(42, 'client_id')}, client_id) - 1 AS i,
    count(*) OVER (PARTITION BY loyalty_target) AS n FROM target_unit"""
DRAWS = f"""SELECT y, n, r.d, {hash_key(42, 'y', 'r.d')} % n AS i FROM (SELECT y, n, max(n) OVER () - n AS need FROM (SELECT loyalty_target AS y, count(*) AS n FROM target_unit GROUP BY 1)),
    range(100000000) r(d) WHERE r.d < need"""
DRAWS = DRAWS.replace("range(100000000)", "(SELECT unnest(range((SELECT count(*) FROM target_unit))))")


@query(
    "random_oversample",
    ["target_unit"],
    f"""SELECT client_id, loyalty_target, is_synthetic, count(*) AS copies FROM (SELECT client_id, loyalty_target, false AS is_synthetic FROM target_unit
        UNION ALL SELECT client_id, loyalty_target, true FROM ({DRAWS}) d JOIN ({INDEXED}) x ON d.y = x.y AND d.i = x.i) GROUP BY 1, 2, 3""",
)
def random_oversample(spark, folder):
    df = sampling.oversample(stages.targeted(spark, folder).select("client_id", "loyalty_target"), "loyalty_target")
    return df.groupBy("client_id", "loyalty_target", "is_synthetic").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "random_undersample",
    ["target_unit"],
    f"""SELECT client_id, loyalty_target FROM ({INDEXED}) WHERE i < (SELECT min(n) FROM (SELECT count(*) AS n FROM target_unit GROUP BY loyalty_target))""",
)
def random_undersample(spark, folder):
    return sampling.undersample(stages.targeted(spark, folder), "loyalty_target").select("client_id", "loyalty_target")


SPACE = ["recency", "frequency", "amount_cv"]
DISTANCE = "sqrt(" + " + ".join(f"pow(a.{f} - b.{f}, 2)" for f in SPACE) + ")"


@query(
    "smote",
    ["target_unit"],
    f"""SELECT * FROM (WITH x AS MATERIALIZED ({INDEXED}), nn AS (SELECT a.y, a.i, b.i AS j, row_number() OVER (PARTITION BY a.y, a.i ORDER BY {DISTANCE}, b.i) - 1 AS k FROM x a JOIN x b ON a.y = b.y AND a.i <> b.i),
        d AS (SELECT y, i, {hash_key(42, "'rank'", 'y', 'd')} % least(5, n - 1) AS k, {hash_key(42, "'gap'", 'y', 'd')} / pow(2, 60) AS gap FROM ({DRAWS}))
        SELECT d.y AS loyalty_target, """
    + ", ".join(f"round(a.{f} + (b.{f} - a.{f}) * gap, 6) AS {f}" for f in SPACE)
    + " FROM d JOIN nn ON d.y = nn.y AND d.i = nn.i AND d.k = nn.k JOIN x a ON a.y = d.y AND a.i = d.i JOIN x b ON b.y = d.y AND b.i = nn.j)",
)
def smote(spark, folder):
    df = sampling.smote(stages.targeted(spark, folder), "loyalty_target", SPACE)
    return rounded(df.filter("is_synthetic").select("loyalty_target", *SPACE))


@query(
    "tomek_removal",
    ["target_unit"],
    f"""SELECT client_id FROM target_unit WHERE client_id NOT IN (SELECT p.id FROM (
          WITH nn AS (SELECT a.client_id AS id, a.loyalty_target AS y, arg_min(b.client_id, {DISTANCE}) AS other, arg_min(b.loyalty_target, {DISTANCE}) AS oy
                      FROM target_unit a JOIN target_unit b ON a.client_id <> b.client_id GROUP BY 1, 2)
          SELECT p.id FROM nn p JOIN nn q ON p.other = q.id AND q.other = p.id WHERE p.y <> p.oy) p)""",
)
def tomek_removal(spark, folder):
    df = stages.targeted(spark, folder).select("client_id", "loyalty_target", *SPACE)
    return sampling.drop_tomek_links(df, "loyalty_target", SPACE).select("client_id")


@query("smote_and_tomek")
def smote_and_tomek(spark, folder):
    df, label, _ = sampling.rebalance(stages.targeted(spark, folder), "sampling", features=SPACE)
    return df.groupBy(label, "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


# the same four on every model feature (37 at these scales, store flags included), as the
# operators choose them by default; SQL has the store shares in long form, so these are
# tested against brute force (tests/test_sampling.py) instead of a twin


@query("smote_all_features")
def smote_all_features(spark, folder):
    df = stages.targeted(spark, folder)
    features = sampling.model_features(df)
    made = sampling.smote(df, "loyalty_target", features).filter("is_synthetic")
    return rounded(made.select("loyalty_target", *features))


@query("tomek_all_features")
def tomek_all_features(spark, folder):
    df = stages.targeted(spark, folder)
    features = sampling.model_features(df)
    return sampling.drop_tomek_links(df.select("client_id", "loyalty_target", *features), "loyalty_target", features).select("client_id")


@query("smote_and_tomek_all_features")
def smote_and_tomek_all_features(spark, folder):
    df, label, _ = sampling.rebalance(stages.targeted(spark, folder), "sampling")
    return df.groupBy(label, "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("balance_combined_all_features")
def balance_combined_all_features(spark, folder):
    df, label, _ = sampling.rebalance(stages.targeted(spark, folder), "combine")
    return df.groupBy(label, "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


RECUT = """SELECT [list_extract(s, 1), list_extract(s, 2), list_extract(s, 3), list_extract(s, 4)] AS b FROM (SELECT list(round(loyalty_score, 2) ORDER BY c) AS s FROM
   (SELECT loyalty_score, row_number() OVER (ORDER BY loyalty_score) - 1 AS rn, count(*) OVER () AS n FROM scored_{m}), (VALUES (15), (35), (60), (85)) v(c) WHERE rn = n * c // 100)"""


@query(
    "balance_by_boundaries",
    ["target_raw", "scored_raw"],
    f"""SELECT balanced_category, {FIVE_CASE.format(c='balanced_category')} AS balanced_target, count(*) AS n FROM
        (SELECT {categories_case('loyalty_score', ['0', 'b[1]', 'b[2]', 'b[3]', 'b[4]', '1'])} AS balanced_category FROM target_raw, ({RECUT.format(m='raw')})) GROUP BY 1""",
)
def balance_by_boundaries(spark, folder):
    df, label, _ = sampling.rebalance(stages.targeted(spark, folder, "raw"), "boundary")
    return df.groupBy("balanced_category", label).agg(F.count(F.lit(1)).alias("n"))


@query("balance_combined")
def balance_combined(spark, folder):
    df, label, _ = sampling.rebalance(stages.targeted(spark, folder), "combine", features=SPACE)
    return df.groupBy(label, "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("balance_none", ["target_unit"], "SELECT loyalty_target, count(*) AS n FROM target_unit GROUP BY 1")
def balance_none(spark, folder):
    df, label, _ = sampling.rebalance(stages.targeted(spark, folder), "none")
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


@query("model_feature_columns", [], "SELECT f AS feature FROM (VALUES " + ", ".join(f"('{f}')" for f in sorted(
    ["frequency", "monetary", "avg_purchase", "amount_std", "bonus_earned_sum", "bonus_earned_mean", "bonus_spent_sum", "bonus_spent_mean", "gender_code", "recency",
     "activity_period", "bonus_usage_ratio", "purchase_frequency", "bonus_earning_ratio", "bonus_activity", "recency_ratio", "purchase_density", "amount_cv", "purchase_stability"])) + ") v(f)")
def model_feature_columns(spark, folder):
    """Leakage exclusion; the share columns vary with the data and are left out of the list."""
    names = sampling.model_features(stages.targeted(spark, folder))
    return spark.createDataFrame([(n,) for n in names if not n.startswith(("location_", "product_"))], "feature string")


# --- importance


def _corr(features: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, abs(corr({f}, loyalty_target)) AS pearson_corr FROM target_unit" for f in features)


def _mi(features: list[str]) -> str:
    one = """SELECT '{f}' AS feature, greatest(sum(n / nn * ln(n * nn / (nb * ny))), 0) AS mutual_info FROM
        (SELECT n, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS nn FROM
         (SELECT b, y, CAST(count(*) AS DOUBLE) AS n FROM (SELECT len(list_filter(cuts, lambda c: {f} > c)) AS b, loyalty_target AS y
          FROM target_unit, (SELECT list_distinct(quantile_cont({f}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS cuts FROM target_unit)) GROUP BY 1, 2))"""
    return " UNION ALL ".join(one.format(f=f) for f in features)


@query("correlation_importance", ["target_unit"], f"SELECT feature, round(pearson_corr, 6) AS pearson_corr FROM ({_corr(FEATURES)})")
def correlation_importance(spark, folder):
    return rounded(imp.correlations(stages.targeted(spark, folder), FEATURES, "loyalty_target"))


COMBINED = f"""SELECT feature, pearson_corr, mutual_info, mutual_info / max(mutual_info) OVER () AS mutual_info_norm,
    (pearson_corr + mutual_info / max(mutual_info) OVER ()) / 2 AS combined_score FROM ({_corr(FEATURES)}) JOIN ({_mi(FEATURES)}) USING (feature)"""


@query("mutual_information", ["target_unit"], f"SELECT feature, round(mutual_info, 6) AS mutual_info FROM ({_mi(FEATURES)})")
def mutual_information(spark, folder):
    return rounded(imp.mutual_information(stages.targeted(spark, folder), FEATURES, "loyalty_target"))


@query(
    "combined_importance",
    ["target_unit"],
    "SELECT feature, round(pearson_corr, 6) AS pearson_corr, round(mutual_info, 6) AS mutual_info, round(mutual_info_norm, 6) AS mutual_info_norm, round(combined_score, 6) AS combined_score FROM ("
    + COMBINED + ")",
)
def combined_importance(spark, folder):
    return rounded(imp.correlation_table(stages.targeted(spark, folder), FEATURES, "loyalty_target"))


LEFT, RIGHT = FEATURES[:6], FEATURES[3:]
INTEGRAL = f"""SELECT feature, pearson_corr_norm, mutual_info_norm,
    (coalesce(pearson_corr_norm, 0) + coalesce(mutual_info_norm, 0)) / (CAST(pearson_corr_norm IS NOT NULL AS INT) + CAST(mutual_info_norm IS NOT NULL AS INT)) AS importance_score
    FROM (SELECT feature, pearson_corr / max(pearson_corr) OVER () AS pearson_corr_norm FROM ({_corr(LEFT)}))
    FULL OUTER JOIN (SELECT feature, mutual_info / max(mutual_info) OVER () AS mutual_info_norm FROM ({_mi(RIGHT)})) USING (feature)"""


def _integral(spark, folder):
    df = stages.targeted(spark, folder)
    left = imp.normalise(imp.correlations(df, LEFT, "loyalty_target"), "pearson_corr")
    right = imp.normalise(imp.mutual_information(df, RIGHT, "loyalty_target"), "mutual_info")
    return imp.integral_score(imp.merge_tables([left, right]))


@query(
    "integral_importance",
    ["target_unit"],
    f"SELECT feature, round(pearson_corr_norm, 6) AS pearson_corr_norm, round(mutual_info_norm, 6) AS mutual_info_norm, round(importance_score, 6) AS importance_score FROM ({INTEGRAL})",
)
def integral_importance(spark, folder):
    return rounded(_integral(spark, folder).select("feature", "pearson_corr_norm", "mutual_info_norm", "importance_score"))


@query("top_features", ["target_unit"], f"SELECT feature, round(pearson_corr, 6) AS pearson_corr FROM ({_corr(FEATURES)}) ORDER BY pearson_corr DESC, feature LIMIT 5")
def top_features(spark, folder):
    table = imp.correlations(stages.targeted(spark, folder), FEATURES, "loyalty_target")
    return rounded(imp.top_features(table, "pearson_corr", 5))


@query("selected_features", ["target_unit"], f"SELECT feature FROM ({INTEGRAL}) WHERE importance_score >= 0.2 ORDER BY importance_score DESC, feature LIMIT 6")
def selected_features(spark, folder):
    names = imp.select_features(_integral(spark, folder), 0.2, 6)
    return spark.createDataFrame([(n,) for n in names], "feature string")


def _forest(spark, folder):
    return stages._once(spark, folder, "forest", lambda: custom_spec("forest", numTrees=10, maxDepth=5).fit(_parts(spark, folder)[0]))


@query("forest_importance")
def forest_importance(spark, folder):
    return imp.forest_importance(_forest(spark, folder), FEATURES, spark)


@query("permutation_importance")
def permutation_importance(spark, folder):
    return imp.permutation_importance(_forest(spark, folder), _parts(spark, folder)[1], FEATURES, repeats=3)


@query("shapley_importance")
def shapley_importance(spark, folder):
    return imp.shapley_importance(_forest(spark, folder), _parts(spark, folder)[1], FEATURES, draws=2)


@query("native_importance")
def native_importance(spark, folder):
    model = QUICK.fit(_parts(spark, folder)[0])
    return imp.top_features(imp.native_importance(model, FEATURES, spark), "importance", 5)


@query("model_data")
def model_data(spark, folder):
    """Ranking, selection, and split in one call; class sizes per part."""
    data = prepare_model_data(
        stages.targeted(spark, folder, "raw"), sampling.EXTREMES, forest=custom_spec("forest", numTrees=5, maxDepth=5), repeats=1, draws=1
    )
    return sampling.class_shares(data.table, "label")


# --- evaluation (a rule plays the classifier, so SQL can follow)

MODELS = """SELECT 'segment' AS model, label, prediction FROM guess UNION ALL SELECT 'score', label, CASE WHEN rfm_score >= 9 THEN 3 WHEN rfm_score >= 7 THEN 2 ELSE 0 END FROM guess"""
BY_MODEL = f"""SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1 FROM (
    SELECT model, class, sum(s) AS support, sum(t) AS hits, CASE WHEN sum(p) > 0 THEN sum(t) / sum(p) ELSE 0 END AS prec, CASE WHEN sum(s) > 0 THEN sum(t) / sum(s) ELSE 0 END AS rec
    FROM (SELECT model, label AS class, 1 AS s, 0 AS p, CAST(label = prediction AS INT) AS t FROM ({MODELS}) UNION ALL SELECT model, prediction, 0, 1, 0 FROM ({MODELS})) GROUP BY model, class)"""
METRICS = f"SELECT model, sum(hits) / sum(support) AS accuracy, avg(prec) AS precision_macro, avg(rec) AS recall_macro, avg(f1) AS f1_macro FROM ({BY_MODEL}) GROUP BY model"
ROUND_METRICS = "model, " + ", ".join(f"round({m}, 6) AS {m}" for m in ev.METRICS)


def _two_models(spark, folder):
    g = stages.guesses(spark, folder)
    first = g.select(F.lit("segment").alias("model"), "label", "prediction")
    rule = F.when(F.col("rfm_score") >= 9, 3).when(F.col("rfm_score") >= 7, 2).otherwise(0)
    return first.unionByName(g.select(F.lit("score").alias("model"), "label", rule.alias("prediction")))


def _counts(spark, folder):
    return ev.confusion(_two_models(spark, folder), keys=["model"])


@query("confusion_matrix", ["guess"], "SELECT model, label, " + ", ".join(f"count(*) FILTER (prediction = {c}) AS predicted_{c}" for c in range(4)) + f" FROM ({MODELS}) GROUP BY 1, 2")
def confusion_matrix(spark, folder):
    return ev.confusion_matrix(_counts(spark, folder), [0, 1, 2, 3], ["model"])


@query("macro_metrics", ["guess"], f"SELECT {ROUND_METRICS} FROM ({METRICS})")
def macro_metrics(spark, folder):
    return rounded(ev.metrics(_counts(spark, folder), ["model"]))


@query(
    "classification_report",
    ["guess"],
    f"""SELECT model, CAST(class AS VARCHAR) AS "row", round(prec, 6) AS "precision", round(rec, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM ({BY_MODEL})
        UNION ALL SELECT model, 'macro avg', round(avg(prec), 6), round(avg(rec), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM ({BY_MODEL}) GROUP BY model
        UNION ALL SELECT model, 'weighted avg', round(sum(prec * support) / sum(support), 6), round(sum(rec * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM ({BY_MODEL}) GROUP BY model""",
)
def classification_report(spark, folder):
    return rounded(ev.report(_counts(spark, folder), ["model"]))


@query("best_model", ["guess"], f"SELECT {ROUND_METRICS} FROM ({METRICS}) ORDER BY f1_macro DESC, model LIMIT 1")
def best_model(spark, folder):
    return rounded(ev.best_model(ev.metrics(_counts(spark, folder), ["model"])))


@query("model_comparison", ["guess"], f"SELECT {ROUND_METRICS} FROM ({METRICS})")
def model_comparison(spark, folder):
    return rounded(ev.compare(ev.metrics(_counts(spark, folder), ["model"])))


@query(
    "metric_comparison",
    ["guess"],
    " UNION ALL ".join(f"SELECT '{m}' AS metric, round(max(CASE WHEN model = 'segment' THEN {m} END), 6) AS segment, round(max(CASE WHEN model = 'score' THEN {m} END), 6) AS score FROM ({METRICS})" for m in ev.METRICS),
)
def metric_comparison(spark, folder):
    return rounded(ev.metric_comparison(ev.metrics(_counts(spark, folder), ["model"])))


@query(
    "class_distribution",
    ["guess"],
    """SELECT coalesce(a.c, b.c) AS class, coalesce(a.n, 0) AS n_true, coalesce(b.n, 0) AS n_predicted FROM (SELECT label AS c, count(*) AS n FROM guess GROUP BY 1) a
       FULL OUTER JOIN (SELECT prediction AS c, count(*) AS n FROM guess GROUP BY 1) b ON a.c = b.c""",
)
def class_distribution(spark, folder):
    return ev.class_distribution(stages.guesses(spark, folder))


THRESHOLDS = """SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, pos, neg, sum(pos) OVER () AS pa, sum(neg) OVER () AS na FROM
    (SELECT rfm_score / 12.0 AS score, sum(CAST(label = 3 AS INT)) AS pos, sum(CAST(label <> 3 AS INT)) AS neg FROM guess GROUP BY 1) WINDOW w AS (ORDER BY score DESC)"""


def _thresholds(spark, folder):
    g = stages.guesses(spark, folder).select((F.col("label") == 3).cast("int").alias("y"), (F.col("rfm_score") / 12.0).alias("score"))
    return ev.threshold_table(g)


@query("roc_points", ["guess"], f"SELECT round(score, 6) AS score, round(tp / pa, 6) AS tpr, round(fp / na, 6) AS fpr FROM ({THRESHOLDS})")
def roc_points(spark, folder):
    return rounded(ev.roc_points(_thresholds(spark, folder)).select("score", "tpr", "fpr"))


@query("precision_recall_points", ["guess"], f"SELECT round(score, 6) AS score, round(tp / (tp + fp), 6) AS \"precision\", round(tp / pa, 6) AS recall FROM ({THRESHOLDS})")
def precision_recall_points(spark, folder):
    return rounded(ev.pr_points(_thresholds(spark, folder)).select("score", "precision", "recall"))


OVR = " UNION ALL ".join(
    f"SELECT {name} AS class, CAST(label = {c} AS INT) AS y, 1.0 / (1 + abs(rfm_score - {3 + 3 * c})) AS score FROM guess" for c in range(4) for name in (f"'{c}'", "'micro'")
)


@query(
    "curve_areas",
    ["guess"],
    f"""SELECT class, round(sum(neg * (tp - pos / 2)) / (max(pa) * max(na)), 6) AS auc, round(sum(pos * tp / (tp + fp)) / max(pa), 6) AS average_precision FROM
        (SELECT class, score, CAST(pos AS DOUBLE) AS pos, CAST(neg AS DOUBLE) AS neg, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp,
         CAST(sum(pos) OVER (PARTITION BY class) AS DOUBLE) AS pa, CAST(sum(neg) OVER (PARTITION BY class) AS DOUBLE) AS na FROM
         (SELECT class, score, sum(y) AS pos, sum(1 - y) AS neg FROM ({OVR}) GROUP BY 1, 2) WINDOW w AS (PARTITION BY class ORDER BY score DESC)) GROUP BY class""",
)
def curve_areas(spark, folder):
    """One-vs-rest and micro-averaged curves."""
    g = stages.guesses(spark, folder)
    scores = F.array(*[F.lit(1.0) / (1 + F.abs(F.col("rfm_score") - (3 + 3 * c))) for c in range(4)])
    long = ev.one_vs_rest(g, [0, 1, 2, 3], scores)
    return rounded(ev.curve_areas(ev.threshold_table(long, keys=["class"]), ["class"]))


# --- models


def _small(names=None):
    return base_specs(SMALL, names)


@query("base_models")
def base_models(spark, folder):
    """The six base models on two classes, trained with class weights."""
    train, test = _parts(spark, folder)
    models, seconds = training.train_all(_small(), sampling.add_weights(train, "label").persist())
    return ev.compare(training.evaluate_all(models, test, seconds)).drop("train_seconds")


@query("multiclass_models")
def multiclass_models(spark, folder):
    """The six base models with their own settings on four classes."""
    train, test = _parts(spark, folder, "unit")
    models, _ = training.train_all(base_specs(), train.persist())
    return training.evaluate_all(models, test)


@query("voting_ensembles")
def voting_ensembles(spark, folder):
    train, test = _parts(spark, folder)
    specs = _small(["logistic_regression", "random_forest"])
    models = {f"{v}_voting": training.voting_ensemble(specs, train, v) for v in ("soft", "hard")}
    return training.evaluate_all(models, test)


@query("stacking_ensemble")
def stacking_ensemble(spark, folder):
    train, test = _parts(spark, folder)
    model = training.stacking_ensemble(_small(["logistic_regression", "random_forest"]), train, k=2)
    return training.evaluate_all({"stacking_ensemble": model}, test)


@query("grid_search")
def grid_search(spark, folder):
    train, _ = _parts(spark, folder)
    candidates = training.grid({"regParam": [0.1, 0.001], "elasticNetParam": [0.0, 1.0]})
    _, _, rows = training.search(QUICK, train, candidates, k=2)
    return training.search_table(spark, "logistic_regression", rows)


@query("random_search")
def random_search(spark, folder):
    train, _ = _parts(spark, folder)
    _, _, rows = training.search(QUICK, train, training.draws(training.search_space("logistic_regression"), 3), k=2)
    return training.score_by_parameter(spark, rows)


@query("tuned_models")
def tuned_models(spark, folder):
    train, _ = _parts(spark, folder)
    specs = {"logistic_regression": QUICK, "svm": Spec("margin", {"maxIter": 5})}
    return training.tune_models(specs, train, "random", n=2, k=2)[1]


@query("cross_validation")
def cross_validation(spark, folder):
    df = _labelled(spark, folder)
    rows = training.summarise(training.cross_validate(QUICK, df, 3), "stratified")
    rows += training.summarise(training.cross_validate(QUICK, df, 3, stratified=False), "plain")
    return spark.createDataFrame([(r["method"], r["metric"], r["train_mean"], r["test_mean"], r["test_std"]) for r in rows], "method string, metric string, train double, test double, std double")


@query("validation_methods")
def validation_methods(spark, folder):
    """Stratified, time-ordered, and repeated validation compared, metric by method."""
    return training.pivot_validation(training.compare_validation(QUICK, _labelled(spark, folder), "last_ts", k=2, runs=2))


@query("model_round_trip")
def model_round_trip(spark, folder):
    """A saved and reloaded model predicts the same classes."""
    from retentio.models.classifiers import load

    train, test = _parts(spark, folder)
    model = training.voting_ensemble(_small(["logistic_regression", "gradient_boosting"]), train)
    path = scratch_path(spark, "model")
    model.save(path)
    before = model.transform(test).select("client_id", F.col("prediction").alias("before"))
    after = load(path).transform(test).select("client_id", F.col("prediction").alias("after"))
    return before.join(after, "client_id").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


# --- scoring


def _bundle(spark, folder) -> scoring.Bundle:
    def make():
        df = stages.features(spark, folder)
        clustering = fit_clusters(df, starts=1)
        projection = fit_projection(clustering.apply(df))
        fitted = Loyalty(clustering, projection, stages.boundaries(spark, folder, "raw"), sampling.EXTREMES)
        names = [*FEATURES, "cluster", "pca_component_1", "pca_component_2"]
        table = assemble(fitted.apply(stages.rfm_customers(spark, folder)).select("client_id", "loyalty_target", *names), names, "loyalty_target")
        model = custom_spec("forest", numTrees=10, maxDepth=5).fit(table)
        cleaning = stages.cleaning(spark, folder)
        _, served = fit_serving(cleaning, stages.customers(spark, folder))
        made = scoring.Bundle("random_forest", model, names, sampling.class_names(sampling.EXTREMES), fitted, cleaning.encoder, cleaning.scaler, served)
        path = scratch_path(spark, "bundle")
        made.save(path)
        return scoring.Bundle.load(path), materialize(model.transform(table).select("client_id", "prediction"), "predicted")

    return stages._once(spark, folder, "bundle", make)


@query("training_equals_serving", ["rfm"], "SELECT count(*) AS customers, CAST(0 AS BIGINT) AS different FROM rfm")
def training_equals_serving(spark, folder):
    """The reloaded bundle scores the training customers exactly as in training."""
    bundle, predicted = _bundle(spark, folder)
    served = scoring.score_customers(stages.rfm_customers(spark, folder), bundle)
    both = served.join(predicted.withColumn("client_id", F.col("client_id").cast("string")), "client_id")
    return both.agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("prediction") != F.col("segment_id")).alias("different"))


@query(
    "purchases_equal_training",
    ["rfm"],
    "SELECT count(*) AS customers, CAST(0 AS BIGINT) AS different, CAST(0 AS BIGINT) AS unmatched FROM rfm",
)
def purchases_equal_training(spark, folder):
    """Raw purchase rows, gaps and outliers included, scored through the reloaded bundle: the
    saved fills, fences, scaler, codes and RFM cuts give every customer its training class."""
    bundle, predicted = _bundle(spark, folder)
    served = scoring.score_purchases(stages.tx(spark, folder), bundle).select("client_id", "segment_id")
    trained = predicted.select(F.col("client_id").cast("string").alias("client_id"), "prediction")
    both = served.join(trained, "client_id", "full")
    present = F.col("segment_id").isNotNull() & F.col("prediction").isNotNull()
    return both.agg(
        F.count_if(present).alias("customers"),
        F.count_if(present & (F.col("prediction") != F.col("segment_id"))).alias("different"),
        F.count_if(~present).alias("unmatched"),
    )


def _profiles(spark, folder):
    """Profile rows as a user would upload them: other headers, mixed formats, gaps."""
    last = F.date_format("last_check_date", "yyyy-MM-dd")
    other = F.date_format("last_check_date", "dd/MM/yyyy")
    facts = stages.tx(spark, folder).groupBy("client_id").agg(
        F.min("last_check_date").alias("last_check_date"), F.min("first_check_date").alias("first_check_date"), F.min("gender").alias("gender"),
        F.min("avg_check").alias("avg_check"), F.sum("bonus_earned").alias("earned"), F.count(F.lit(1)).alias("k"), F.max("store").alias("store"),
    )
    segment = F.col("gender")
    return facts.select(
        F.col("client_id").alias("ID Клиента"),
        F.when(segment == "FURNITURE", "GARDEN").otherwise(segment).alias("gender"),
        F.col("store").alias("Purchase Store"),
        F.when(segment == "HOUSEHOLD", other).when(segment == "MACHINERY", "unknown").otherwise(last).alias("Дата последнего чека"),
        F.when(segment != "BUILDING", F.date_format("first_check_date", "yyyy-MM-dd")).alias("First Purchase Date"),
        F.when(segment == "AUTOMOBILE", F.lit(None)).otherwise(F.col("k").cast("string")).alias("Количество"),
        F.when(segment == "FURNITURE", "n/a").otherwise(F.round("earned", 4).cast("string")).alias("Начислено бонусов"),
        F.when(segment != "HOUSEHOLD", F.col("avg_check").cast("string")).alias("Средняя сумма покупок"),
        F.lit("250.5").alias("Cумма покупки"),
    )


PROFILES = f"""SELECT client_id, gender, recency, frequency, monetary, avg_purchase, activity_period, earned FROM (
  SELECT client_id, gender, coalesce({days("TIMESTAMP '2001-08-01'", 'last')}, 365) AS recency, CASE WHEN gender IS NOT DISTINCT FROM 'AUTOMOBILE' THEN 1 ELSE k END AS frequency,
    CASE WHEN coalesce(gender <> 'HOUSEHOLD', false) THEN c * CASE WHEN gender IS NOT DISTINCT FROM 'AUTOMOBILE' THEN 1 ELSE k END ELSE 250.5 END AS monetary,
    CASE WHEN coalesce(gender <> 'HOUSEHOLD', false) THEN c ELSE 250.5 END AS avg_purchase,
    greatest(coalesce({days('last', 'coalesce(first_seen, last)')} + 1, 1), 1) AS activity_period, CASE WHEN gender = 'FURNITURE' THEN 0 ELSE e END AS earned
  FROM (SELECT client_id, min(gender) AS gender, CASE WHEN coalesce(min(gender) = 'MACHINERY', false) THEN NULL ELSE min(last_check_date) END AS last,
        CASE WHEN coalesce(min(gender) <> 'BUILDING', false) THEN min(first_check_date) END AS first_seen, min(avg_check) AS c, round(sum(bonus_earned), 4) AS e, count(*) AS k FROM tx GROUP BY client_id))"""


@query(
    "profile_features",
    ["tx"],
    f"""SELECT client_id, CAST(recency AS BIGINT) AS recency, round(CAST(frequency AS DOUBLE), 4) AS frequency, {single('monetary')} AS monetary, {single('avg_purchase')} AS avg_purchase, CAST(activity_period AS BIGINT) AS activity_period,
        round(recency / activity_period, 6) AS recency_ratio, round(frequency / activity_period, 6) AS purchase_density, round(earned, 4) AS bonus_earned_sum,
        {single('earned / 2')} AS bonus_activity FROM ({PROFILES})""",
)
def profile_features(spark, folder):
    """RFM and derived features of uploaded profiles before any model."""
    df = scoring.standardise_input(_profiles(spark, folder))
    made = scoring.profile_features(scoring.profile_rfm(df, F.lit("2001-08-01").cast("timestamp")))
    keep = ["client_id", "recency", "frequency", "monetary", "avg_purchase", "activity_period", "recency_ratio", "purchase_density", "bonus_earned_sum", "bonus_activity"]
    return rounded(made.select(*keep), 6, monetary=SINGLE, avg_purchase=SINGLE, frequency=4, bonus_earned_sum=4, bonus_activity=SINGLE)


def _rated_profiles(spark, folder):
    """Profiles with a purchase rate a month: a third of the count, blank or not a number for some."""
    facts = stages.tx(spark, folder).groupBy("client_id").agg(F.min("gender").alias("g"), F.count(F.lit(1)).alias("k"))
    rate = F.when(F.col("g") == "HOUSEHOLD", F.lit(None)).when(F.col("g") == "BUILDING", "n/a").otherwise(F.round(F.col("k") / 3.0, 4).cast("string"))
    return _profiles(spark, folder).join(facts.select(F.col("client_id").alias("ID Клиента"), rate.alias("Частота, раз/мес")), "ID Клиента")


@query(
    "profile_rates",
    ["tx"],
    f"""SELECT client_id, round(CAST(frequency AS DOUBLE), 4) AS frequency, {single('monetary')} AS monetary, round(frequency / activity_period, 6) AS purchase_density
        FROM (SELECT client_id, activity_period, coalesce(rate, frequency) AS frequency,
                CASE WHEN coalesce(gender <> 'HOUSEHOLD', false) THEN c * coalesce(rate, frequency) ELSE 250.5 END AS monetary
              FROM ({PROFILES.replace("avg_purchase, activity_period, earned FROM (", "avg_purchase, activity_period, earned, rate, c FROM (").replace(
                  "CASE WHEN gender = 'FURNITURE' THEN 0 ELSE e END AS earned", "CASE WHEN gender = 'FURNITURE' THEN 0 ELSE e END AS earned, c, CASE WHEN gender = 'HOUSEHOLD' OR gender = 'BUILDING' THEN NULL ELSE round(k / 3.0, 4) END AS rate")}))""",
)
def profile_rates(spark, folder):
    """The rate branch of profile RFM: frequency is the rate where it parses, else the count, and
    monetary is the average check times that frequency."""
    df = scoring.standardise_input(_rated_profiles(spark, folder))
    made = scoring.profile_features(scoring.profile_rfm(df, F.lit("2001-08-01").cast("timestamp")))
    return rounded(made.select("client_id", "frequency", "monetary", "purchase_density"), 6, monetary=SINGLE, frequency=4)


@query(
    "profile_encoding",
    ["tx", "top_stores", "genders"],
    """SELECT CAST(gender_code AS INT) AS gender_code, location, count(*) AS n FROM (SELECT coalesce(g.gender_code, 0) AS gender_code, CASE WHEN t.store IS NULL THEN 'location_other'
       ELSE 'location_' || replace(replace(replace(replace(p.store, ' ', '_'), ',', ''), '.', ''), '/', '_') END AS location
       FROM (SELECT client_id, CASE WHEN min(gender) = 'FURNITURE' THEN 'GARDEN' ELSE min(gender) END AS gender, max(store) AS store FROM tx GROUP BY client_id) p
       LEFT JOIN genders g ON p.gender = g.gender LEFT JOIN top_stores t ON p.store = t.store) GROUP BY 1, 2""",
)
def profile_encoding(spark, folder):
    encoder = stages.cleaning(spark, folder).encoder
    df = scoring.encode_input(scoring.standardise_input(_profiles(spark, folder)), encoder)
    flags = df.unpivot(["gender_code"], encoder.store_columns, "location", "flag").filter("flag = 1")
    return flags.groupBy("gender_code", "location").agg(F.count(F.lit(1)).alias("n"))


@query("profile_scoring")
def profile_scoring(spark, folder):
    """Uploaded profiles to segment, name, and class probabilities."""
    bundle, _ = _bundle(spark, folder)
    scored = scoring.score_profiles(_profiles(spark, folder), bundle, "2001-08-01")
    return scored.select("client_id", "segment_id", "segment_name", F.to_json("probabilities").alias("probabilities"))


@query(
    "profile_scoring_sums",
    ["tx"],
    "SELECT count(DISTINCT client_id) AS profiles, 0::BIGINT AS sums_off, 0::BIGINT AS not_the_largest FROM tx WHERE client_id IS NOT NULL",
)
def profile_scoring_sums(spark, folder):
    """Probabilities of a scored profile sum to one, and its segment has the largest."""
    bundle, _ = _bundle(spark, folder)
    scored = scoring.score_profiles(_profiles(spark, folder), bundle, "2001-08-01")
    chances = F.map_values("probabilities")
    total = F.aggregate(chances, F.lit(0.0), lambda s, v: s + v)
    own = F.try_element_at("probabilities", F.col("segment_name"))
    return scored.agg(
        F.count(F.lit(1)).alias("profiles"),
        F.count_if(F.abs(total - 1) > 1e-3).alias("sums_off"),
        F.count_if(F.coalesce(own, F.lit(-1.0)) < F.array_max(chances)).alias("not_the_largest"),
    )


@query("segment_distribution")
def segment_distribution(spark, folder):
    bundle, _ = _bundle(spark, folder)
    return scoring.segment_distribution(scoring.score_customers(stages.rfm_customers(spark, folder), bundle))


@query("training_run")
def training_run(spark, folder):
    """Balance, ranking, split, training, and evaluation as one run."""
    data = prepare_model_data(
        stages.targeted(spark, folder, "raw"), sampling.EXTREMES, selection=False, test_share=0.2
    )
    return train_models(data, custom=SMALL, names=["logistic_regression", "random_forest"])[1].drop("train_seconds")
