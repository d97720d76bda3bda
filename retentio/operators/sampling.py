"""Targets, class balance, splits and folds.

Rows are ordered by a seeded hash of their id. The k smallest hashes of a class are found
as an order statistic, so neither a class nor the table is ever sorted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.functions.columns import hash_key, numeric_columns
from retentio.operators import categories
from retentio.operators.neighbors import nearest
from retentio.operators.quantiles import rank_values
from retentio.operators.ranking import with_row_index
from retentio.session import materialize

CLASS_LIMIT = 1_000

# Class of each category when more than two are present.
FIVE_TO_FOUR = {"Отток": 0, "Низколояльные": 0, "Умеренно лояльные": 1, "Лояльные": 2, "Высоколояльные": 3}
EXTREMES = {"Отток": 0, "Высоколояльные": 1}
LEAKS = {
    "client_id",
    "loyalty_score",
    "bonus_usage_normalized",
    "loyalty_category",
    "loyalty_segment",
    "cluster_segment",
    "R",
    "F",
    "M",
    "rfm_score",
    "rfm_group",
    "weighted_rfm",
    "loyalty_target",
    "balanced_target",
    "balanced_category",
    "is_synthetic",
    "split",
    "weight",
    "fold",
}


def fit_target(df: DataFrame, category: str = categories.CATEGORY) -> dict[str, int]:
    """Class of each category present; more than ``CLASS_LIMIT`` categories are an error."""
    present = set(class_counts(df, category))
    if present == set(EXTREMES):
        return dict(EXTREMES)
    if len(present) <= 2:
        return {name: i for i, name in enumerate(sorted(present))}
    return dict(FIVE_TO_FOUR)


def class_names(mapping: dict[str, int]) -> dict[int, str]:
    """Readable name per class; merged categories are joined by a slash."""
    names: dict[int, str] = {}
    for name, code in mapping.items():
        names[code] = f"{names[code]}/{name}" if code in names else name
    return names


def add_target(df: DataFrame, mapping: dict[str, int], category: str = categories.CATEGORY, target: str = "loyalty_target") -> DataFrame:
    chain = None
    for name, code in mapping.items():
        hit = F.col(category) == name
        chain = F.when(hit, code) if chain is None else chain.when(hit, code)
    return df.withColumn(target, chain)


def unmapped(df: DataFrame, target: str = "loyalty_target") -> DataFrame:
    return df.agg(F.count_if(F.col(target).isNull()).alias("unmapped"), F.count(F.lit(1)).alias("n_rows"))


def class_counts(df: DataFrame, label: str) -> dict:
    rows = df.filter(F.col(label).isNotNull()).groupBy(label).count().limit(CLASS_LIMIT + 1).collect()
    if len(rows) > CLASS_LIMIT:
        raise ValueError(f"{label} has more than {CLASS_LIMIT} classes")
    return dict(sorted((row[0], row[1]) for row in rows))


def imbalance(df: DataFrame, label: str) -> DataFrame:
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).count()
    return counts.agg((F.max("count") / F.min("count")).alias("imbalance"))


def model_features(df: DataFrame, target: str = "loyalty_target") -> list[str]:
    """Numeric columns that may feed a model: no ids, scores, RFM parts, or targets."""
    return [c for c in numeric_columns(df, (target,)) if c not in LEAKS and not c.endswith("_target")]


def allocate(counts: dict, total: int) -> dict:
    """Split ``total`` over the classes in proportion, largest remainders first."""
    n = sum(counts.values())
    exact = {c: counts[c] * total / n for c in counts}
    given = {c: int(math.floor(v)) for c, v in exact.items()}
    rest = sorted(counts, key=lambda c: (-(exact[c] - given[c]), c))
    for c in rest[: total - sum(given.values())]:
        given[c] += 1
    return given


def _cuts(df: DataFrame, strata: dict, key: Column, ranks: dict[object, list[int]]) -> dict:
    """Hash values at the wanted 0-based ranks of each stratum: ``{stratum: [cut, ...]}``."""
    wanted = {str(s): (F.when(condition, key), ranks[s]) for s, condition in strata.items() if ranks[s]}
    values = rank_values(df, wanted)
    return {s: [values[str(s)][r] for r in ranks[s]] if ranks[s] else [] for s in strata}


def _strata(df: DataFrame, label: str | None) -> tuple[dict, dict]:
    if label is None:
        return {"all": F.lit(True)}, {"all": df.count()}
    counts = class_counts(df, label)
    return {c: F.col(label) == F.lit(c) for c in counts}, counts


def _first_by_hash(df: DataFrame, strata: dict, sizes: dict, seed: int, ids: list[str]) -> Column:
    """True for exactly ``sizes[s]`` rows of each stratum, chosen by hash order."""
    for attempt in range(3):
        key = hash_key(*[F.col(i) for i in ids], seed=seed + 1_000_003 * attempt)
        ranks = {s: [sizes[s] - 1] if sizes[s] > 0 else [] for s in strata}
        cuts = _cuts(df, strata, key, ranks)
        chosen = {s: (strata[s] & (key <= F.lit(cuts[s][0]))) if cuts[s] else F.lit(False) for s in strata}
        checks = [F.count_if(c).alias(str(i)) for i, c in enumerate(chosen.values())]
        got = df.agg(*checks).first()
        if all(got[str(i)] == sizes[s] for i, s in enumerate(strata)):
            picked = F.lit(False)
            for c in chosen.values():
                picked = picked | F.coalesce(c, F.lit(False))
            return picked
    raise ValueError(f"the columns {ids} do not identify rows, so an exact share cannot be cut")


def split(
    df: DataFrame, label: str | None = None, test_share: float = 0.2, seed: int = 42, ids: tuple[str, ...] = ("client_id",)
) -> DataFrame:
    """Add ``split`` (train/test) with exact sizes, stratified when a label is given."""
    strata, counts = _strata(df, label)
    n_test = math.ceil(sum(counts.values()) * test_share)
    picked = _first_by_hash(df, strata, allocate(counts, n_test), seed, list(ids))
    return df.withColumn("split", F.when(picked, "test").otherwise("train"))


def folds(df: DataFrame, label: str | None, k: int = 5, seed: int = 42, ids: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """Add ``fold`` 0..k-1; per class the folds are consecutive stretches of hash order."""
    strata, counts = _strata(df, label)
    key = hash_key(*[F.col(i) for i in ids], seed=seed)
    ends = {}
    for s, n in counts.items():
        sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
        ends[s] = [sum(sizes[: i + 1]) - 1 for i in range(k - 1)]
    cuts = _cuts(df, strata, key, {s: [e for e in ends[s] if e >= 0] for s in strata})
    fold = F.lit(None).cast("int")
    for s, condition in strata.items():
        inner = F.lit(k - 1)
        for i in reversed(range(k - 1)):
            if ends[s][i] >= 0:
                cut = cuts[s][len([e for e in ends[s][:i] if e >= 0])]
                inner = F.when(key <= F.lit(cut), i).otherwise(inner)
        fold = F.when(condition, inner).otherwise(fold)
    return df.withColumn("fold", fold)


def time_folds(df: DataFrame, time: str, k: int = 5, seed: int = 42, ids: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """Add ``block`` 0..k of equal size in time order; block i tests a model of the earlier ones.

    Rows of one instant are told apart by hash, so a crowded instant may straddle blocks.
    """
    instant = F.unix_micros(F.col(time).cast("timestamp"))
    sizes: dict[str, int] = {}

    def ends(n: int) -> list[int]:
        return [(n * (i + 1)) // (k + 1) - 1 for i in range(k) if (n * (i + 1)) // (k + 1) > 0]

    times = rank_values(df, {"t": (instant, ends)}, sizes)["t"]
    wanted = ends(sizes["t"])
    before = df.agg(*[F.count_if(instant < F.lit(times[e])).alias(f"b{e}") for e in dict.fromkeys(wanted)]).first()
    key = hash_key(*[F.col(i) for i in ids], seed=seed)
    inner = {str(e): (F.when(instant == F.lit(times[e]), key), [e - before[f"b{e}"]]) for e in dict.fromkeys(wanted)}
    cuts = rank_values(df, inner)
    block = F.lit(k)
    for i in reversed(range(len(wanted))):
        e = wanted[i]
        cut = cuts[str(e)][e - before[f"b{e}"]]
        earlier = (instant < F.lit(times[e])) | ((instant == F.lit(times[e])) & (key <= F.lit(cut)))
        block = F.when(earlier, i).otherwise(block)
    return df.withColumn("block", block)


def class_shares(df: DataFrame, label: str, part: str = "split") -> DataFrame:
    """Count and percentage of every class within each part."""
    counts = df.groupBy(part, label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(part).agg(F.sum("n").alias("_t"))
    return counts.join(totals, part).select(part, label, "n", (F.col("n") * 100.0 / F.col("_t")).alias("percent"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (k x n_c) per class."""
    counts = class_counts(df, label)
    n, k = sum(counts.values()), len(counts)
    return (
        df.filter(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("weight", F.lit(float(n)) / (F.lit(k) * F.col("n")))
    )


def add_weights(df: DataFrame, label: str, counts: dict | None = None) -> DataFrame:
    counts = counts or class_counts(df, label)
    n, k = sum(counts.values()), len(counts)
    chain = None
    for c, size in counts.items():
        hit, value = F.col(label) == F.lit(c), F.lit(n / (k * size))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return df.withColumn("weight", chain)


def undersample(df: DataFrame, label: str, seed: int = 42, ids: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """Every class cut to the size of the smallest."""
    strata, counts = _strata(df, label)
    smallest = min(counts.values())
    return df.filter(_first_by_hash(df, strata, {s: smallest for s in strata}, seed, list(ids)))


def _draws(spark, label: str, kind, counts: dict, seed: int) -> DataFrame:
    """One row per row to add: class, draw number, and the index of its source row."""
    largest = max(counts.values())
    drawn = None
    for c, n in counts.items():
        if n == largest:
            continue
        part = spark.range(largest - n).select(
            F.lit(c).cast(kind).alias(label),
            F.col("id").alias("_draw"),
            F.pmod(hash_key(F.lit(str(c)), F.col("id"), seed=seed), F.lit(n)).alias("_index"),
        )
        drawn = part if drawn is None else drawn.unionByName(part)
    return drawn


def oversample(df: DataFrame, label: str, seed: int = 42, ids: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """Classes raised to the largest by seeded draws with replacement; originals are kept."""
    counts = class_counts(df, label)
    kept = df.withColumn("is_synthetic", F.lit(False))
    draws = _draws(df.sparkSession, label, df.schema[label].dataType, counts, seed)
    if draws is None:
        return kept
    small = [c for c, n in counts.items() if n < max(counts.values())]
    key = hash_key(*[F.col(i) for i in ids], seed=seed)
    source = with_row_index(df.filter(F.col(label).isin(small)), [key, *ids], "_index", [label])
    copies = draws.join(source, [label, "_index"]).withColumn("is_synthetic", F.lit(True))
    return kept.unionByName(copies.select(*kept.columns))


def smote(
    df: DataFrame, label: str, features: list[str], k: int = 5, seed: int = 42, ids: tuple[str, ...] = ("client_id",)
) -> DataFrame:
    """Synthetic rows between a minority row and one of its k nearest rows of the class.

    Returns features, label, and ``is_synthetic``; ids of synthetic rows are null.
    """
    counts = class_counts(df, label)
    largest = max(counts.values())
    small = {c: n for c, n in counts.items() if n < largest}
    columns = [*ids, label, *[f for f in features if f not in ids]]
    kept = df.select(*columns).withColumns({f: F.col(f).cast("double") for f in features}).withColumn(
        "is_synthetic", F.lit(False)
    )
    if not small:
        return kept
    if min(small.values()) < 2:
        raise ValueError("a class with a single row has no neighbours to interpolate with")
    key = hash_key(*[F.col(i) for i in ids], seed=seed)
    vector = F.array(*[F.col(f).cast("double") for f in features]).alias("_v")
    rows = df.filter(F.col(label).isin(list(small))).select(label, *ids, vector)
    indexed = materialize(with_row_index(rows, [key, *ids], "_index", [label]).select(label, "_index", "_v"), "smote")

    # copies of one vector are neighbours of each other at distance 0: search among
    # distinct vectors and let the number of copies decide how many ranks they take
    distinct = materialize(
        indexed.groupBy(label, "_v").agg(F.min("_index").alias("_rep"), F.count(F.lit(1)).alias("_copies")), "smote"
    )
    found = None
    for c in small:
        vectors = distinct.filter(F.col(label) == F.lit(c)).select(F.col("_rep").alias("id"), F.col("_v").alias("vector"))
        part = nearest(vectors, k).select(
            F.lit(c).cast(df.schema[label].dataType).alias(label), F.col("id").alias("_rep"), F.inline("neighbours")
        )
        found = part if found is None else found.unionByName(part)
    # a neighbour with copies takes as many ranks; at most k lists of at most k ids per row
    sized = found.join(distinct.select(label, F.col("_rep").alias("id"), F.least("_copies", F.lit(k)).alias("_c")), [label, "id"])
    lists = sized.groupBy(label, "_rep").agg(F.array_sort(F.collect_list(F.struct("distance", "id", "_c"))).alias("_near")).select(
        label,
        "_rep",
        F.slice(F.flatten(F.transform("_near", lambda x: F.array_repeat(x["id"], x["_c"].cast("int")))), 1, k).alias("_ids"),
    )

    draws = _draws(df.sparkSession, label, df.schema[label].dataType, counts, seed)
    reach = F.lit(k)
    for c, n in small.items():
        reach = F.when(F.col(label) == F.lit(c), F.lit(min(k, n - 1))).otherwise(reach)
    unit = F.lit(float(2**60))
    draws = draws.withColumns(
        {
            "_rank": F.pmod(hash_key(F.lit("rank"), F.col(label), F.col("_draw"), seed=seed), reach),
            "_gap": hash_key(F.lit("gap"), F.col(label), F.col("_draw"), seed=seed) / unit,
        }
    )
    based = draws.join(indexed, [label, "_index"]).join(distinct, [label, "_v"]).join(lists, [label, "_rep"], "left")
    # ranks 0..copies-2 are copies of the row itself, the next ones come from the list
    own = F.col("_rank") < F.col("_copies") - 1
    picked = F.when(own, F.col("_rep")).otherwise(
        F.try_element_at(F.col("_ids"), (F.col("_rank") - F.col("_copies") + 2).cast("int"))
    )
    based = based.withColumn("_other", F.coalesce(picked, F.col("_rep")))
    other = distinct.select(label, F.col("_rep").alias("_other"), F.col("_v").alias("_w"))
    mixed = based.join(other, [label, "_other"]).withColumn(
        "_new", F.zip_with("_v", "_w", lambda a, b: a + (b - a) * F.col("_gap"))
    )
    synthetic = mixed.select(
        *[F.lit(None).cast(df.schema[i].dataType).alias(i) for i in ids],
        label,
        *[F.col("_new")[i].alias(f) for i, f in enumerate(features) if f not in ids],
        F.lit(True).alias("is_synthetic"),
    )
    return kept.unionByName(synthetic.select(*kept.columns))


def drop_tomek_links(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Drop both rows of every pair of mutual nearest neighbours of different class."""
    vector = F.array(*[F.col(f).cast("double") for f in features])
    rows = materialize(
        df.withColumn("_v", vector).withColumn("_id", F.monotonically_increasing_id()), "tomek"
    )
    # numbers only, so that rows are grouped in a hash table; the label is that of a vector without copies
    groups = materialize(
        rows.groupBy("_v").agg(F.min("_id").alias("_a"), F.min(label).alias("_label"), F.count(F.lit(1)).alias("_copies")), "tomek"
    )
    # copies: the two smallest ids are each other's nearest row
    mark = F.struct(F.col("_id").alias("id"), F.col(label).alias("label"))
    seconds = (
        rows.join(groups.filter("_copies > 1"), "_v")
        .groupBy("_v")
        .agg(F.min(F.when(F.col("_id") == F.col("_a"), mark)).alias("_first"), F.min(F.when(F.col("_id") != F.col("_a"), mark)).alias("_second"))
        .filter(F.col("_first.label") != F.col("_second.label"))
        .select(F.explode(F.array("_first.id", "_second.id")).alias("_id"))
    )
    one = nearest(groups.select(F.col("_a").alias("id"), F.col("_v").alias("vector")), 1)
    single = groups.filter("_copies = 1").select(F.col("_a").alias("id"), F.col("_label").alias("label"))
    pairs = (
        one.select("id", F.get(F.col("neighbours"), F.lit(0))["id"].alias("other"))
        .join(single, "id")
        .join(single.select(F.col("id").alias("other"), F.col("label").alias("other_label")), "other")
    )
    back = pairs.select(F.col("id").alias("other"), F.col("other").alias("id"))
    mutual = pairs.filter(F.col("label") != F.col("other_label")).join(back, ["id", "other"], "left_semi")
    linked = mutual.select(F.col("id").alias("_id")).unionByName(seconds)
    return rows.join(linked, "_id", "left_anti").select(*df.columns)


def smote_tomek(df: DataFrame, label: str, features: list[str], k: int = 5, seed: int = 42, ids=("client_id",)) -> DataFrame:
    return drop_tomek_links(smote(df, label, features, k, seed, ids), label, features)


def resample(df: DataFrame, label: str, method: str, features: list[str], seed: int = 42, ids=("client_id",)) -> DataFrame:
    if method == "random_over":
        return oversample(df, label, seed, ids)
    if method == "random_under":
        return undersample(df, label, seed, ids)
    if method == "smote":
        return smote(df, label, features, seed=seed, ids=ids)
    if method == "combine":
        return smote_tomek(df, label, features, seed=seed, ids=ids)
    raise ValueError(f"unknown resampling method {method}")


def category_shares(n: int) -> list[float]:
    """Wanted percentage per category: fuller middle for five, even otherwise."""
    return [15.0, 20.0, 25.0, 25.0, 15.0] if n == 5 else [100.0 / n] * n


def rebalance(
    df: DataFrame, method: str = "none", label: str = "loyalty_target", score: str = categories.SCORE,
    features: list[str] | None = None, seed: int = 42, n: int = 5,
) -> tuple[DataFrame, str, dict[str, int] | None]:
    """Balance the classes: the table, its target column, and the new category map if the target was re-cut."""
    if method == "none":
        return df, label, None
    if method in ("boundary", "optimize_boundaries", "combine"):
        counts = class_counts(df, label)
        if method != "combine" and max(counts.values()) / min(counts.values()) <= 3:
            return df, label, None
        bounds = categories.optimise_boundaries(df, category_shares(n), score)
        recut = categories.categorise(df, bounds, score, "balanced_category")
        recut = add_target(recut, FIVE_TO_FOUR, "balanced_category", "balanced_target")
        if method != "combine":
            return recut, "balanced_target", dict(FIVE_TO_FOUR)
        made = smote(recut, "balanced_target", features or model_features(recut), seed=seed)
        return made, "balanced_target", dict(FIVE_TO_FOUR)
    if method == "sampling":
        return smote_tomek(df, label, features or model_features(df, label), seed=seed), label, None
    return resample(df, label, method, features or model_features(df, label), seed), label, None
