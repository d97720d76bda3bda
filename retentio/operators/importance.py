"""Feature relevance: correlation, mutual information, forest, permutation, Shapley values."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentio.functions.columns import hash_key, row_mean, total
from retentio.operators.profile import pearson_table
from retentio.operators.quantiles import exact_quantiles

BUCKET_ROWS = 1_000


def correlations(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """abs(Pearson r) with a numeric target, all features in one pass."""
    table = pearson_table(df, [(f, label) for f in features])
    return table.select(F.col("a").alias("feature"), F.abs("r").alias("pearson_corr"))


def mutual_information(df: DataFrame, features: list[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of quantile-binned features with a discrete target."""
    cuts = exact_quantiles(df, features, [i / bins for i in range(1, bins)])
    parts = []
    for f in features:
        x = F.col(f).cast("double")
        edges = sorted({c for c in cuts[f] if c is not None})
        index = total([(x > F.lit(c)).cast("int") for c in edges]) if edges else F.lit(0)
        parts.append(F.struct(F.lit(f).alias("feature"), F.coalesce(index, F.lit(-1)).alias("bin")))
    cells = (
        df.filter(F.col(label).isNotNull())
        .select(F.col(label).alias("y"), F.inline(F.array(*parts)))
        .groupBy("feature", "bin", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # at most features x bins x classes rows from here on
    by_bin = F.sum("n").over(Window.partitionBy("feature", "bin"))
    by_class = F.sum("n").over(Window.partitionBy("feature", "y"))
    whole = F.sum("n").over(Window.partitionBy("feature"))
    sized = cells.select("feature", "n", by_bin.alias("nb"), by_class.alias("ny"), whole.alias("nn"))
    term = F.col("n") / F.col("nn") * F.log(F.col("n") * F.col("nn") / (F.col("nb") * F.col("ny")))
    return sized.groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mutual_info"))


def normalise(df: DataFrame, column: str) -> DataFrame:
    """Add ``<column>_norm`` = value / maximum (0 when the maximum is not positive)."""
    top = F.max(column).over(Window.partitionBy(F.lit(0)))
    name = {"rf_importance": "rf", "perm_importance": "perm", "shap_importance": "shap"}.get(column)
    target = f"{name}_importance_norm" if name else f"{column}_norm"
    return df.withColumn(target, F.when(top > 0, F.col(column) / top).otherwise(F.lit(0.0)))


def correlation_table(df: DataFrame, features: list[str], label: str, bins: int = 10, numeric: bool = True) -> DataFrame:
    """Pearson, mutual information, and their combined score."""
    table = normalise(mutual_information(df, features, label, bins), "mutual_info")
    if not numeric:
        return table.withColumn("combined_score", F.col("mutual_info_norm"))
    joined = correlations(df, features, label).join(table, "feature", "full_outer")
    return joined.withColumn("combined_score", (F.col("pearson_corr") + F.col("mutual_info_norm")) / 2)


def native_importance(model, features: list[str], spark) -> DataFrame:
    """Importances a fitted model carries itself: gains, or mean absolute coefficients."""
    values = model.importances()
    if values is None:
        raise ValueError("this model has no importances of its own")
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double")


def forest_importance(model, features: list[str], spark) -> DataFrame:
    return normalise(native_importance(model, features, spark).withColumnRenamed("importance", "rf_importance"), "rf_importance")


def with_donor(df: DataFrame, ids: list[str], value: str, seed: int, n: int) -> DataFrame:
    """Add ``_donor``: the value of another row at random.

    Rows go to hash buckets of about a thousand; inside a bucket each takes the value of
    the next row in hash order and the last one that of the first. That is a permutation of
    the whole table made with one shuffle and bounded groups.
    """
    key = hash_key(*[F.col(i) for i in ids], seed=seed)
    buckets = max(1, n // BUCKET_ROWS)
    keyed = df.withColumn("_key", key).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)))
    order = Window.partitionBy("_bucket").orderBy("_key", *ids)
    donor = F.coalesce(F.lead(value).over(order), F.first(value).over(order))
    return keyed.withColumn("_donor", donor).drop("_key", "_bucket")


def permutation_importance(
    model, df: DataFrame, features: list[str], label: str = "label", ids: tuple[str, ...] = ("client_id",),
    repeats: int = 10, seed: int = 42,
) -> DataFrame:
    """Mean loss of accuracy when one feature's values are permuted; ``df`` is held-out data."""
    n, d = df.count(), len(features)
    rows = df.select(*ids, F.col(label).alias("label"), F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    right = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    plain = model.transform(rows.withColumn("features", array_to_vector("_x"))).agg(right).first()[0]
    scores = None
    for r in range(repeats):
        paired = with_donor(rows, list(ids), "_x", seed + r, n)
        swapped = paired.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(d - 1)))).withColumn(
            "features",
            array_to_vector(
                F.zip_with(
                    "_x", F.transform("_donor", lambda v, i: F.when(i == F.col("_f"), v)), lambda x, z: F.coalesce(z, x)
                )
            ),
        )
        part = model.transform(swapped.select("_f", "label", "features")).groupBy("_f").agg(right.alias("_a"))
        scores = part if scores is None else scores.unionByName(part)
    names = F.array(*[F.lit(f) for f in features])
    table = scores.groupBy("_f").agg((F.lit(plain) - F.avg("_a")).alias("perm_importance"))
    named = table.select(F.try_element_at(names, (F.col("_f") + 1).cast("int")).alias("feature"), "perm_importance")
    return normalise(named, "perm_importance")


def shapley_values(
    model, df: DataFrame, features: list[str], ids: tuple[str, ...] = ("client_id",), draws: int = 4, seed: int = 42
) -> DataFrame:
    """Sampled Shapley values: one row per input row, feature, and class.

    Each draw orders the features at random and walks from a random other row to the row
    itself; the change in score at a feature's step is its effect. The steps of a walk add
    up to f(row) - f(other row) exactly. Both ends of a step are scored on one row, so the
    walks need no shuffle beyond the pairing of rows.
    """
    n, d = df.count(), len(features)
    rows = df.select(*ids, F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    parts = None
    for r in range(draws):
        paired = with_donor(rows, list(ids), "_x", seed + r, n)
        order = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.xxhash64(*[F.col(c) for c in ids], F.lit(seed + r), i))
        steps = paired.withColumn("_o", order).withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(d - 1))))
        here = F.col("_o")[F.col("_f")]

        def walked(inclusive: bool) -> Column:
            pairs = F.zip_with("_o", F.arrays_zip("_x", "_donor"), lambda o, p: F.when((o <= here) if inclusive else (o < here), p["_x"]).otherwise(p["_donor"]))
            return array_to_vector(pairs)

        before = model.transform(steps.withColumn("features", walked(False))).withColumnRenamed("scores", "_before").drop("features", "prediction")
        after = model.transform(before.withColumn("features", walked(True)))
        effect = F.zip_with("scores", "_before", lambda a, b: a - b)
        part = after.select(*ids, "_f", effect.alias("_e"))
        parts = part if parts is None else parts.unionByName(part)
    names = F.array(*[F.lit(f) for f in features])
    # the partial aggregation folds the draws of a row before anything is shuffled
    long = parts.select(*ids, "_f", F.posexplode("_e").alias("class_index", "_v"))
    mean = long.groupBy(*ids, "_f", "class_index").agg(F.avg("_v").alias("shapley"))
    return mean.withColumn("feature", F.try_element_at(names, (F.col("_f") + 1).cast("int"))).drop("_f")


def shapley_importance(model, df: DataFrame, features: list[str], ids: tuple[str, ...] = ("client_id",), draws: int = 4, seed: int = 42) -> DataFrame:
    """Mean absolute Shapley value: of class 1 for two classes, over all classes otherwise."""
    values = shapley_values(model, df, features, ids, draws, seed)
    if len(model.classes) == 2:
        values = values.filter("class_index = 1")
    size = F.abs("shapley")
    table = values.groupBy("feature").agg(
        F.avg(size).alias("shap_importance"), (F.stddev_samp(size) / F.sqrt(F.count(F.lit(1)))).alias("shap_error")
    )
    return normalise(table, "shap_importance")


def merge_tables(tables: list[DataFrame]) -> DataFrame:
    merged = tables[0]
    for t in tables[1:]:
        merged = merged.join(t, "feature", "full_outer")
    return merged


def integral_score(table: DataFrame) -> DataFrame:
    """Mean of the normalised columns a feature has, best first."""
    norms = [c for c in table.columns if c.endswith("_norm")]
    scored = table.withColumn("importance_score", row_mean(norms)) if norms else table
    return scored.orderBy(F.desc("importance_score"), "feature") if norms else scored


def top_features(table: DataFrame, column: str, n: int = 20) -> DataFrame:
    return table.filter(F.col(column).isNotNull()).orderBy(F.desc(column), "feature").limit(n)


SCORE_COLUMNS = {
    "score": "importance_score",
    "correlation": "combined_score",
    "model": "rf_importance",
    "permutation": "perm_importance",
    "shap": "shap_importance",
}


def select_features(table: DataFrame, minimum: float = 0.05, at_most: int = 30, method: str = "score", available: list[str] | None = None) -> list[str]:
    """Names of the best features by one column (there are at most ``at_most``)."""
    column = SCORE_COLUMNS.get(method)
    if column not in table.columns:
        options = [c for c in table.columns if c.endswith(("_importance", "_score"))]
        if not options:
            raise ValueError("the table has no importance column")
        column = options[0]
    best = top_features(table.filter(F.col(column) >= minimum), column, at_most).select("feature").collect()
    names = [row[0] for row in best]
    return [f for f in names if available is None or f in available]


def chosen_or_all(selected: list[str], features: list[str], few: int = 5) -> tuple[list[str], str | None]:
    """Fall back to all features when none is left; say so when few are."""
    if not selected:
        return list(features), "no feature reached the threshold, all are used"
    if len(selected) < few:
        return selected, f"only {len(selected)} features reached the threshold"
    return selected, None


def evaluate_features(
    df: DataFrame, features: list[str], label: str = "label", model=None, held_out: DataFrame | None = None,
    methods: tuple[str, ...] = ("correlation", "model_based", "permutation", "shap"), repeats: int = 10, draws: int = 4,
    seed: int = 42, ids: tuple[str, ...] = ("client_id",),
) -> DataFrame:
    """All requested importances merged, with the integral score."""
    tables = []
    if {"correlation", "mutual_info"} & set(methods):
        tables.append(correlation_table(df, features, label))
    if {"model_based", "rf_importance"} & set(methods):
        tables.append(forest_importance(model, features, df.sparkSession))
    if "permutation" in methods:
        tables.append(permutation_importance(model, held_out, features, label, ids, repeats, seed))
    if "shap" in methods:
        tables.append(shapley_importance(model, held_out, features, ids, draws, seed))
    return integral_score(merge_tables(tables))
