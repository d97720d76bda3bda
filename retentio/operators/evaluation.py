"""Classification metrics from counts, threshold curves, and comparison tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.operators.ranking import running_total

METRICS = ["accuracy", "precision_macro", "recall_macro", "f1_macro"]


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", keys: list[str] | None = None) -> DataFrame:
    """(label, prediction, n): all later metrics derive from these few rows."""
    return df.groupBy(
        *(keys or []), F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(counts: DataFrame, classes: list[int], keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    wide = counts.groupBy(*keys, "label").pivot("prediction", classes).agg(F.sum("n"))
    return wide.select(*keys, "label", *[F.coalesce(F.col(str(c)), F.lit(0)).alias(f"predicted_{c}") for c in classes])


def class_metrics(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1, support per class; an empty denominator gives 0."""
    keys = keys or []
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    sides = counts.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), hit.cast("long").alias("t")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("t")),
            )
        ),
    )
    summed = sides.groupBy(*keys, "class").agg(
        F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("t").alias("hits")
    )
    zero = F.lit(0.0)
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(zero)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(zero)
    rated = summed.withColumns({"precision": precision, "recall": recall})
    both = F.col("precision") + F.col("recall")
    return rated.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(zero))


def metrics(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Accuracy and macro precision, recall, F1."""
    return (
        class_metrics(counts, keys)
        .groupBy(*(keys or []))
        .agg(
            (F.sum("hits") / F.sum("support")).alias("accuracy"),
            F.avg("precision").alias("precision_macro"),
            F.avg("recall").alias("recall_macro"),
            F.avg("f1").alias("f1_macro"),
        )
    )


def metric_values(df: DataFrame, label: str = "label", prediction: str = "prediction") -> dict[str, float]:
    return metrics(confusion(df, label, prediction)).first().asDict()


def report(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Classification report: one row per class plus macro and weighted averages."""
    keys = keys or []
    rows = class_metrics(counts, keys)
    names = ["precision", "recall", "f1"]
    per_class = rows.select(*keys, F.col("class").cast("string").alias("row"), *names, "support")
    macro = rows.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in names], F.sum("support").alias("support"))
    weighted = rows.groupBy(*keys).agg(
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in names],
        F.sum("support").alias("support"),
    )
    return per_class.unionByName(macro.select(*keys, F.lit("macro avg").alias("row"), *names, "support")).unionByName(
        weighted.select(*keys, F.lit("weighted avg").alias("row"), *names, "support")
    )


def one_vs_rest(df: DataFrame, classes: list[int], scores: Column, label: str = "label") -> DataFrame:
    """(class, y, score) rows for every class, plus all of them again as class ``micro``.

    ``scores`` is an array column with one score per class.
    """
    parts = []
    for i, c in enumerate(classes):
        y = (F.col(label) == F.lit(c)).cast("int")
        parts.append(F.struct(F.lit(str(c)).alias("class"), y.alias("y"), scores[i].alias("score")))
        parts.append(F.struct(F.lit("micro").alias("class"), y.alias("y"), scores[i].alias("score")))
    return df.select(F.inline(F.array(*parts)))


def probability_array(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))


def threshold_table(df: DataFrame, y: str = "y", score: str = "score", keys: list[str] | None = None) -> DataFrame:
    """True and false positives at every distinct score, highest first, by range slices."""
    keys = keys or []
    counted = df.groupBy(*keys, score).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg")
    )
    table = running_total(counted, [F.desc(score)], {"tp": "pos", "fp": "neg"}, keys)
    if keys:
        totals = counted.groupBy(*keys).agg(F.sum("pos").alias("p_all"), F.sum("neg").alias("n_all"))
        return table.join(totals, keys)
    whole = counted.agg(F.sum("pos"), F.sum("neg")).first()
    return table.withColumns({"p_all": F.lit(whole[0]), "n_all": F.lit(whole[1])})


def roc_points(table: DataFrame) -> DataFrame:
    return table.withColumn("tpr", F.col("tp") / F.greatest(F.col("p_all"), F.lit(1))).withColumn(
        "fpr", F.col("fp") / F.greatest(F.col("n_all"), F.lit(1))
    )


def pr_points(table: DataFrame) -> DataFrame:
    return table.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn(
        "recall", F.col("tp") / F.greatest(F.col("p_all"), F.lit(1))
    )


def curve_areas(table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """ROC AUC (trapezoids) and average precision; each threshold knows its own step."""
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg"))
    p_all, n_all = F.col("p_all").cast("double"), F.col("n_all").cast("double")
    auc = F.sum(neg * (tp - pos / 2)) / F.nullif(F.max(p_all * n_all), F.lit(0.0))
    ap = F.sum(pos * tp / (tp + fp)) / F.nullif(F.max(p_all), F.lit(0.0))
    return table.groupBy(*(keys or [])).agg(auc.alias("auc"), ap.alias("average_precision"))


def class_distribution(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """True and predicted class sizes aligned by class."""
    true = df.groupBy(F.col(label).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n_true"))
    guess = df.groupBy(F.col(prediction).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n_predicted"))
    joined = true.join(guess, "class", "full_outer")
    return joined.select("class", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_true", "n_predicted")])


def compare(results: DataFrame, metric: str = "f1_macro") -> DataFrame:
    return results.orderBy(F.desc(metric), "model")


def best_model(results: DataFrame, metric: str = "f1_macro") -> DataFrame:
    return compare(results, metric).limit(1)


def metric_comparison(results: DataFrame) -> DataFrame:
    """One row per metric, one column per model."""
    long = results.unpivot(["model"], METRICS, "metric", "value")
    models = [row["model"] for row in results.select("model").distinct().orderBy("model").collect()]
    return long.groupBy("metric").pivot("model", models).agg(F.first("value"))
