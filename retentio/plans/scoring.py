"""Batch scoring with everything that was fitted in training."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio import schema
from retentio.functions.columns import has, parse_timestamp, whole_days
from retentio.models import classifiers
from retentio.operators.clusters import Clustering, Projection
from retentio.operators.encode import Encoder, label_code, named_stores, to_number
from retentio.operators.impute import fill_placeholders
from retentio.operators.loyalty import add_features
from retentio.operators.scaling import Scaler
from retentio.plans.serving import Serving, load_serving, save_serving
from retentio.plans.stages import Loyalty, assemble, loyalty_as_dict, loyalty_from_dict
from retentio.sources.files import path_exists, read_json_value, write_json_value

# Stand-ins for features that an input does not allow to compute.
PLACEHOLDERS = {
    "recency_ratio": 0.5,
    "amount_cv": 0.2,
    "purchase_stability": 0.8,
    "recency": 180,
    "pca_component_3": 0.0,
    "monetary": 5000,
    "amount_std": 1000,
    "pca_component_2": 0.0,
    "avg_purchase": 1500,
    "pca_component_1": 0.0,
    "cluster": 2,
    "bonus_earning_ratio": 0.1,
    "bonus_earned_sum": 500,
    "bonus_activity": 250,
    "bonus_earned_mean": 50,
    "frequency": 10,
    "purchase_frequency": 0.5,
    "purchase_density": 0.05,
}
UNKNOWN_RECENCY = 365


@dataclass
class Bundle:
    """A trained model with its feature list, class names, and fitted statistics.

    ``serving`` (optional) holds the fitted cleaning and RFM passes, which new purchase rows
    need (:func:`score_purchases`); profiles and customer tables do without.
    """

    name: str
    model: classifiers.Fitted
    features: list[str]
    names: dict[int, str]
    loyalty: Loyalty
    encoder: Encoder
    scaler: Scaler | None
    serving: Serving | None = None

    def save(self, path: str) -> None:
        self.model.save(f"{path}/model")
        about = {
            "name": self.name,
            "features": self.features,
            "names": {str(k): v for k, v in self.names.items()},
            "loyalty": loyalty_as_dict(self.loyalty),
            "encoder": asdict(self.encoder),
            "scaler": asdict(self.scaler) if self.scaler else None,
        }
        write_json_value(about, f"{path}/bundle")
        if self.serving is not None:
            save_serving(self.serving, f"{path}/serving")

    @staticmethod
    def load(path: str) -> "Bundle":
        missing = missing_parts(SparkSession.active(), path)
        if missing:
            raise FileNotFoundError(f"{path} lacks {', '.join(missing)}")
        about = read_json_value(f"{path}/bundle")
        return Bundle(
            about["name"],
            classifiers.load(f"{path}/model"),
            about["features"],
            {int(k): v for k, v in about["names"].items()},
            loyalty_from_dict(about["loyalty"]),
            Encoder(**about["encoder"]),
            Scaler(**about["scaler"]) if about["scaler"] else None,
            load_serving(SparkSession.active(), f"{path}/serving"),
        )


def missing_parts(spark: SparkSession, path: str) -> list[str]:
    """Critical parts a saved bundle lacks."""
    return [part for part in ("bundle", "model") if not path_exists(spark, f"{path}/{part}")]


def profile_rfm(df: DataFrame, as_of: Column) -> DataFrame:
    """Recency, frequency, monetary, and average purchase from profile fields.

    Recency runs from the last check to the given analysis date, 365 when unknown. The
    frequency is the rate, else the quantity, else 1; monetary is average check x frequency,
    else the amount, else 0.
    """
    null = F.lit(None).cast("double")

    def number(name: str) -> Column:
        return F.col(name).cast("double") if has(df, name) else null

    last = F.col("last_check_date") if has(df, "last_check_date") else F.lit(None).cast("timestamp")
    days = whole_days(F.date_trunc("DAY", as_of), F.date_trunc("DAY", last.cast("timestamp")))
    frequency = F.coalesce(number("freq_per_month"), number("quantity"), F.lit(1.0))
    check, amount = number("avg_check"), number("amount")
    monetary = F.coalesce(F.when(frequency > 0, check * frequency), amount, F.lit(0.0))
    return df.withColumns(
        {
            "recency": F.coalesce(days, F.lit(UNKNOWN_RECENCY)).cast("long"),
            "frequency": frequency,
            "monetary": monetary,
            "avg_purchase": F.coalesce(number("avg_purchase"), check, amount, F.lit(0.0)),
        }
    )


def training_units(df: DataFrame, scaler: Scaler | None) -> DataFrame:
    """Profile money in the units the model was trained in; counts and rates stay as they are.

    Training scales purchase amounts and then sums or averages them, so every amount of a
    profile is scaled with the range of ``amount``; bonuses have ranges of their own.
    """
    if scaler is None:
        return df
    ranges = {"amount": "amount", "avg_check": "amount", "avg_purchase": "amount", "bonus_earned": "bonus_earned", "bonus_spent": "bonus_spent"}
    return df.withColumns(
        {
            c: F.when(F.col(c).isNotNull(), (F.col(c) - scaler.shift[r]) / scaler.width[r] if scaler.width[r] else F.lit(0.0))
            for c, r in ranges.items()
            if has(df, c) and r in scaler.shift
        }
    )


def profile_features(df: DataFrame) -> DataFrame:
    """Features derived from a profile; one purchase known means no spread."""
    span = F.lit(None).cast("long")
    if has(df, "first_check_date", "last_check_date"):
        first, last = (F.date_trunc("DAY", F.col(c).cast("timestamp")) for c in ("first_check_date", "last_check_date"))
        span = whole_days(last, first) + 1
    earned = F.coalesce(F.col("bonus_earned").cast("double"), F.lit(0.0)) if has(df, "bonus_earned") else F.lit(0.0)
    spent = F.coalesce(F.col("bonus_spent").cast("double"), F.lit(0.0)) if has(df, "bonus_spent") else F.lit(0.0)
    timed = df.withColumn("activity_period", F.greatest(F.coalesce(span, F.lit(1)), F.lit(1)).cast("long"))
    return timed.withColumns(
        {
            "recency_ratio": F.coalesce(F.col("recency") / F.col("activity_period"), F.lit(0.5)),
            "purchase_density": F.coalesce(F.col("frequency") / F.col("activity_period"), F.lit(0.05)),
            "purchase_frequency": F.coalesce(F.col("frequency").cast("double"), F.lit(1.0)),
            "bonus_earned_sum": earned,
            "bonus_earned_mean": earned,
            "bonus_spent_sum": spent,
            "bonus_spent_mean": spent,
            "bonus_earning_ratio": F.when(F.col("monetary") > 0, earned / F.col("monetary")).otherwise(F.lit(0.0)),
            "bonus_activity": (earned + spent) / 2,
            "amount_std": F.lit(0.0),
            "amount_cv": F.lit(0.0),
            "purchase_stability": F.lit(1.0),
        }
    )


def standardise_input(raw: DataFrame) -> DataFrame:
    """Aliases resolved, numbers coerced, dates parsed in either format."""
    df = schema.resolve_aliases(raw)
    if not has(df, "client_id"):
        df = df.withColumn("client_id", F.concat(F.lit("row_"), F.monotonically_increasing_id().cast("string")))
    fixed: dict[str, Column] = {}
    for name, default in (("amount", 0), ("quantity", 1), ("bonus_earned", 0), ("bonus_spent", 0)):
        if has(df, name):
            fixed[name] = to_number(F.col(name), default)
    for name in ("freq_per_month", "avg_check"):
        if has(df, name):
            fixed[name] = F.col(name).cast("string").try_cast("double")
    for name in ("last_check_date", "first_check_date"):
        if has(df, name):
            fixed[name] = parse_timestamp(F.col(name).cast("string"), "dd/MM/yyyy")
    df = df.withColumns(fixed)
    if has(df, "last_check_date") and not has(df, "first_check_date"):
        df = df.withColumn("first_check_date", F.col("last_check_date"))
    elif has(df, "last_check_date"):
        df = df.withColumn("first_check_date", F.coalesce("first_check_date", "last_check_date"))
    return df


def encode_input(df: DataFrame, encoder: Encoder) -> DataFrame:
    """Gender code and store flags from the fitted lists; unknown stores count as other."""
    gender = label_code(F.col("gender"), encoder.gender_codes) if has(df, "gender") else F.lit(0)
    store = F.coalesce(F.col("store").cast("string"), F.lit("")) if has(df, "store") else F.lit("")
    flags = {name: (store == s).cast("int") for s, name in named_stores(encoder.top_stores).items()}
    return df.withColumns({"gender_code": gender, **flags, "location_other": (~store.isin(encoder.top_stores)).cast("int")})


def add_learned(df: DataFrame, clustering: Clustering, projection: Projection) -> DataFrame:
    """Cluster and components; features the input lacks take placeholders or 0."""
    wanted = dict.fromkeys([*clustering.standardiser.columns, *projection.standardiser.columns])
    absent = {c: PLACEHOLDERS.get(c, 0.0) for c in wanted if c not in df.columns and c != "cluster"}
    filled = df.withColumns({c: F.lit(float(v)) for c, v in absent.items()})
    return projection.apply(clustering.apply(filled))


def scored_rows(df: DataFrame, bundle: Bundle) -> DataFrame:
    """(client_id, segment_id, segment_name, probabilities) of rows with the model's features."""
    ordered = fill_placeholders(df, {f: PLACEHOLDERS.get(f, 0.0) for f in bundle.features})
    vectors = assemble(ordered.select("client_id", *bundle.features), bundle.features)
    scored = bundle.model.transform(vectors)
    names = F.array(*[F.lit(bundle.names.get(c, f"Класс {c}")) for c in bundle.model.classes])
    rounded = F.transform("scores", lambda p: F.round(p, 4))
    name = F.lit(None).cast("string")
    for c in bundle.model.classes:
        name = F.when(F.col("prediction") == c, bundle.names.get(c, f"Класс {c}")).otherwise(name)
    return scored.select(
        F.col("client_id").cast("string").alias("client_id"),
        F.col("prediction").cast("int").alias("segment_id"),
        name.alias("segment_name"),
        F.map_from_arrays(names, rounded).alias("probabilities"),
    )


def score_profiles(raw: DataFrame, bundle: Bundle, as_of: str | None = None) -> DataFrame:
    """Score uploaded profile rows. The analysis date is explicit; default today."""
    df = training_units(standardise_input(raw), bundle.scaler)
    now = F.to_timestamp(F.lit(as_of)) if as_of else F.current_timestamp()
    df = profile_features(profile_rfm(encode_input(df, bundle.encoder), now))
    return scored_rows(add_learned(df, bundle.loyalty.clustering, bundle.loyalty.projection), bundle)


def score_customers(customers: DataFrame, bundle: Bundle) -> DataFrame:
    """Score an aggregated customer table with the training features."""
    featured = add_features(customers, bundle.loyalty.parity)
    return scored_rows(add_learned(featured, bundle.loyalty.clustering, bundle.loyalty.projection), bundle)


def score_purchases(transactions: DataFrame, bundle: Bundle, as_of: str | None = None) -> DataFrame:
    """Score new raw purchase rows with what training fitted, refitting nothing.

    Rows pass the saved fills (per-customer medians by a join, then global medians and
    modes), fences, scaler and codes, are aggregated per customer, scored by the saved RFM
    cuts (customers that training would have dropped as incomplete are dropped here too) and
    then scored like a customer table. Recency counts to the training date unless ``as_of``
    is given.
    """
    if bundle.serving is None:
        raise ValueError("this bundle was saved without its fitted cleaning; purchase rows cannot be scored")
    return score_customers(bundle.serving.customers(transactions, as_of), bundle)


def segment_distribution(scored: DataFrame, segment: str = "segment_name") -> DataFrame:
    return scored.groupBy(segment).agg(F.count(F.lit(1)).alias("n"))
