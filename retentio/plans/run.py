"""End-to-end run: purchases to trained, evaluated, and saved models."""

from __future__ import annotations

import argparse
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.models.classifiers import base_specs
from retentio.models.training import draws, evaluate_all, search, search_space, stacking_ensemble, train_all, voting_ensemble
from retentio.operators.encode import Encoder
from retentio.operators.evaluation import best_model
from retentio.operators.sampling import add_weights
from retentio.operators.scaling import Scaler
from retentio.plans.scoring import Bundle
from retentio.plans.stages import (
    Loyalty,
    ModelData,
    customers_from,
    fit_cleaning,
    fit_loyalty,
    loyalty_as_dict,
    loyalty_from_dict,
    prepare_model_data,
    rfm_customers,
)
from retentio.session import materialize, prepare, spark_session
from retentio.sources.files import (
    read_json_value,
    read_table,
    read_transactions,
    require_path,
    require_rows,
    write_csv,
    write_json_value,
    write_table,
)


@dataclass
class Result:
    loyalty: DataFrame
    data: ModelData
    metrics: DataFrame
    bundle: Bundle
    seconds: dict[str, float]


def train_models(
    data: ModelData, weights: bool = True, custom: dict | None = None, names: list[str] | None = None, trials: int = 0,
    folds: int = 3, ensemble: str | None = None, parallelism: int = 2, seed: int = 42,
):
    """Optional search, training of the base models, optional ensemble, evaluation."""
    train, test = data.part("train"), data.part("test")
    if weights:
        train = add_weights(train, "label")
    columns = [c for c in ("client_id", "_row", "label", "features", "weight") if c in train.columns]
    train = train.select(*columns).persist()
    try:
        specs = base_specs(custom, names, rows=data.about["train_size"])
        if trials:
            for name in specs:
                best, _, _ = search(specs[name], train, draws(search_space(name), trials, seed), folds, seed=seed)
                specs[name] = specs[name].with_params(**best)
        models, seconds = train_all(specs, train, parallelism)
        if ensemble in ("soft", "hard"):
            models["voting_ensemble"] = voting_ensemble(specs, train, ensemble)
        elif ensemble == "stacking":
            models["stacking_ensemble"] = stacking_ensemble(specs, train)
    finally:
        train.unpersist()
    return models, evaluate_all(models, test, seconds)


def preprocess(
    transactions: DataFrame, product_rules=None, passes: int = 2, stage_input: bool = True
) -> tuple[DataFrame, Encoder, Scaler | None]:
    """Cleaned, aggregated, and scored customers with the statistics scoring needs.

    The fits read the purchases several times, so text files and joined views are written
    as a columnar table first (``stage_input``).
    """
    source = materialize(transactions, "transactions") if stage_input else transactions
    cleaning = fit_cleaning(source, **({} if product_rules is None else {"product_rules": product_rules}))
    return rfm_customers(customers_from(cleaning), passes), cleaning.encoder, cleaning.scaler


def run(
    transactions: DataFrame | None, output: str | None = None, product_rules=None, clusters: int | str = 5, starts: int = 10,
    passes: int = 2, parity: bool = True, base_scale: str = "raw", balance: str = "none", at_most: int = 50, repeats: int = 10,
    shap_draws: int = 4, custom: dict | None = None, names: list[str] | None = None, trials: int = 0, ensemble: str | None = None,
    weights: bool = True, parallelism: int = 2, seed: int = 42, stage_input: bool = True, save_stages: bool = False,
    resume: tuple[str, ...] = (), spark: SparkSession | None = None,
) -> Result:
    """The whole run. ``save_stages`` keeps stage tables in the output folder and ``resume``
    (``preprocess``, ``loyalty``) reads them back instead of computing them again."""
    start, seconds = time.time(), {}

    def lap(name: str) -> None:
        nonlocal start
        seconds[name] = round(time.time() - start, 3)
        start = time.time()

    def stored(name: str) -> tuple[DataFrame, dict]:
        session = spark or SparkSession.active()
        require_path(session, f"{output}/stages/{name}")
        return session.read.parquet(f"{output}/stages/{name}"), read_json_value(f"{output}/stages/{name}_fitted")

    def store(name: str, table: DataFrame, fitted: dict) -> None:
        write_table(table, f"{output}/stages/{name}")
        write_json_value(fitted, f"{output}/stages/{name}_fitted")

    if "preprocess" in resume or "loyalty" in resume:
        rfm, about = stored("preprocess")
        encoder, scaler = Encoder(**about["encoder"]), Scaler(**about["scaler"]) if about["scaler"] else None
    else:
        rfm, encoder, scaler = preprocess(transactions, product_rules, passes, stage_input)
        if save_stages:
            store("preprocess", rfm, {"encoder": asdict(encoder), "scaler": asdict(scaler) if scaler else None})
    lap("preprocess")
    if "loyalty" in resume:
        loyalty, about = stored("loyalty")
        fitted = loyalty_from_dict(about)
    else:
        loyalty, fitted = fit_loyalty(rfm, clusters, starts, parity=parity, base_scale=base_scale, seed=seed)
        if save_stages:
            store("loyalty", loyalty, loyalty_as_dict(fitted))
    lap("loyalty")
    data = prepare_model_data(loyalty, fitted.target, balance, at_most=at_most, repeats=repeats, draws=shap_draws, seed=seed)
    lap("model_data")
    models, metrics = train_models(data, weights, custom, names, trials, ensemble=ensemble, parallelism=parallelism, seed=seed)
    metrics = metrics.persist()
    best = best_model(metrics).first()["model"]
    lap("train")
    bundle = Bundle(best, models[best], data.features, data.names, fitted, encoder, scaler)
    if output:
        write_table(loyalty, f"{output}/loyalty_features")
        write_table(data.table.drop("features"), f"{output}/model_data")
        write_json_value(data.about, f"{output}/model_data_about")
        if data.importance is not None:
            write_csv(data.importance, f"{output}/feature_importance")
        write_csv(metrics, f"{output}/metrics")
        bundle.save(f"{output}/best_model")
        lap("write")
    return Result(loyalty, data, metrics, bundle, seconds)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Customer-loyalty run over a purchase file")
    parser.add_argument("--input", required=True, help="purchase CSV, or a Parquet folder")
    parser.add_argument("--output", required=True)
    parser.add_argument("--balance", default="none")
    parser.add_argument("--trials", type=int, default=0, help="search draws per model; 0 = no search")
    parser.add_argument("--ensemble", choices=["soft", "hard", "stacking"])
    parser.add_argument("--no-class-weights", action="store_true")
    parser.add_argument("--save-stages", action="store_true")
    parser.add_argument("--resume", nargs="*", default=[], choices=["preprocess", "loyalty"])
    parser.add_argument("--seed", type=int, default=42)
    options = parser.parse_args(arguments)
    spark = prepare(spark_session("retentio"))
    text = options.input.endswith(".csv")
    source = None
    if not options.resume:
        source = require_rows((read_transactions if text else read_table)(spark, options.input))
    result = run(
        source, options.output, balance=options.balance, trials=options.trials, ensemble=options.ensemble,
        weights=not options.no_class_weights, seed=options.seed, stage_input=text, save_stages=options.save_stages,
        resume=tuple(options.resume), spark=spark,
    )
    result.metrics.orderBy(F.desc("f1_macro")).show(truncate=False)


if __name__ == "__main__":
    main()
