"""The served cleaning: everything training fitted between raw purchases and customers.

Scoring new purchase rows must not fit anything anew: the fills (per-customer medians,
global medians, modes), the fences, the scaler, the codes, the sparse columns each RFM pass
dropped, the quartile cuts of both passes and the date recency is counted from are fitted
once in training, saved next to the model and applied as expressions and one join (the
per-customer median table, which is a table and stays one).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions.columns import has
from retentio.operators.customers import add_periods, aggregate_customers
from retentio.operators.encode import Encoder
from retentio.operators.impute import Imputer
from retentio.operators.rfm import apply_rfm, fit_cuts, missing_metrics, sparse_columns
from retentio.operators.scaling import Fences, Scaler
from retentio.plans.stages import Cleaning
from retentio.session import materialize
from retentio.sources.files import path_exists, read_json_value, write_json_value

FORMAT = 1


@dataclass
class RfmPasses:
    """Per pass: the sparse columns dropped and the R, F, M quartile cuts."""

    dropped: list[list[str]]
    cuts: list[dict[str, list[float]]]

    def apply(self, customers: DataFrame) -> DataFrame:
        """Score with the fitted cuts, drop the fitted columns and the incomplete customers."""
        for dropped, cuts in zip(self.dropped, self.cuts):
            if cuts and not missing_metrics(customers):
                customers = apply_rfm(customers, cuts)
            customers = customers.drop(*dropped).dropna("any")
        return customers


def fit_rfm_passes(customers: DataFrame, passes: int = 2) -> tuple[DataFrame, RfmPasses]:
    """The passes of ``two_pass_rfm``, with what each fitted kept."""
    fitted = RfmPasses([], [])
    for _ in range(passes):
        dropped = sparse_columns(customers)
        cuts = {} if missing_metrics(customers) else fit_cuts(customers)
        customers = materialize(RfmPasses([dropped], [cuts]).apply(customers), "rfm")
        fitted.dropped.append(dropped)
        fitted.cuts.append(cuts)
    return customers, fitted


@dataclass
class Serving:
    cleaning: Cleaning
    rfm: RfmPasses
    as_of: str | None  # recency is counted to this time (text in the session's time zone)

    def clean(self, transactions: DataFrame) -> DataFrame:
        return self.cleaning.apply(transactions)

    def customers(self, transactions: DataFrame, as_of: str | None = None) -> DataFrame:
        """Purchase rows -> fitted fills, fences, scale, codes -> customers -> fitted RFM passes.

        ``as_of`` overrides the training date for recency (new purchases of a later day).
        """
        grouped = aggregate_customers(self.clean(transactions), keep=True)
        when = as_of or self.as_of
        if when is not None and has(grouped, "last_ts"):
            grouped = add_periods(grouped.drop("recency", "activity_period", "purchase_frequency", "bonus_usage_ratio"), when)
        return self.rfm.apply(grouped)


def fit_serving(cleaning: Cleaning, customers: DataFrame, passes: int = 2) -> tuple[DataFrame, Serving]:
    """From the fitted cleaning and the customers aggregated from its output."""
    as_of = None
    if has(customers, "last_ts"):
        as_of = customers.agg(F.date_format(F.max("last_ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    scored, rfm = fit_rfm_passes(customers, passes)
    return scored, Serving(cleaning, rfm, as_of)


def save_serving(serving: Serving, path: str) -> None:
    imputer = serving.cleaning.imputer
    if imputer.customer_medians is not None:
        imputer.customer_medians.write.mode("overwrite").parquet(f"{path}/customer_medians")
    about = {
        "format": FORMAT,
        "imputer": {
            "key": imputer.key,
            "median_columns": imputer.median_columns,
            "date_types": {c: t.json() for c, t in imputer.date_types.items()},
            "global_medians": imputer.global_medians,
            "values": imputer.values,
            "missing_before": imputer.missing_before,
            "customer_medians": imputer.customer_medians is not None,
        },
        "fences": {c: asdict(f) for c, f in serving.cleaning.fences.items()},
        "scaler": asdict(serving.cleaning.scaler) if serving.cleaning.scaler else None,
        "encoder": asdict(serving.cleaning.encoder),
        "rfm": asdict(serving.rfm),
        "as_of": serving.as_of,
    }
    write_json_value(about, f"{path}/about")


def load_serving(spark: SparkSession, path: str) -> Serving | None:
    """None where nothing was saved (bundles of earlier versions)."""
    if not path_exists(spark, f"{path}/about"):
        return None
    about = read_json_value(f"{path}/about")
    if about.get("format") != FORMAT:
        raise ValueError(f"{path}: serving format {about.get('format')}, expected {FORMAT}")
    saved = about["imputer"]
    imputer = Imputer(
        saved["key"],
        saved["median_columns"],
        {c: T._parse_datatype_json_string(t) for c, t in saved["date_types"].items()},
        spark.read.parquet(f"{path}/customer_medians") if saved["customer_medians"] else None,
        saved["global_medians"],
        saved["values"],
        saved["missing_before"],
    )
    cleaning = Cleaning(
        imputer,
        {c: Fences(**f) for c, f in about["fences"].items()},
        Scaler(**about["scaler"]) if about["scaler"] else None,
        Encoder(**about["encoder"]),
    )
    return Serving(cleaning, RfmPasses(about["rfm"]["dropped"], about["rfm"]["cuts"]), about["as_of"])
