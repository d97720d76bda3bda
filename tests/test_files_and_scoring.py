import datetime as dt

import pytest
from pyspark.sql import functions as F

from retentio import schema
from retentio.models.classifiers import custom_spec
from retentio.operators.clusters import fit_clusters, fit_projection
from retentio.operators.encode import Encoder
from retentio.plans import scoring
from retentio.plans.stages import Loyalty, assemble
from retentio.sources import files


def test_csv_with_original_headers(spark, tmp_path):
    path = str(tmp_path / "in")
    header = ["Клиент", "Пол", "Дата покупки", "Cумма покупки", "Количество"]
    df = spark.createDataFrame([("7", "M", "2024-02-01 10:00:00", "12.5", "2"), ("8", None, "bad", "x", "3")], [f"c{i}" for i in range(5)]).toDF(*header)
    files.write_csv(df, path)
    got = files.read_transactions(spark, path).orderBy("client_id").collect()
    assert [r["client_id"] for r in got] == [7, 8]
    assert got[0]["purchase_ts"] == dt.datetime(2024, 2, 1, 10) and got[1]["purchase_ts"] is None and got[1]["amount"] is None


def test_missing_and_empty_inputs(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        files.require_rows(spark.createDataFrame([], "a int"))


def test_stage_is_read_back(spark, tmp_path):
    place = str(tmp_path)
    files.Stages(spark, place).get("s", lambda: spark.range(3))
    assert files.Stages(spark, place, ("s",)).get("s", None).count() == 3
    with pytest.raises(FileNotFoundError):
        files.Stages(spark, place, ("t",)).get("t", None)


def test_prepared_data_needs_a_label(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError):
        files.read_prepared(spark, str(tmp_path / "p"))
    spark.range(2).withColumn("loyalty_class", F.lit(1)).write.parquet(str(tmp_path / "q"))
    assert files.read_prepared(spark, str(tmp_path / "q")).count() == 2


def test_nan_becomes_null(spark):
    from retentio.functions.columns import nan_to_null

    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert nan_to_null(df).agg(F.count("x")).first()[0] == 1


def test_profile_rfm_fallbacks(spark):
    rows = [("1", "10/01/2024", "2", "3", "50"), ("2", "nonsense", None, "4", None), ("3", None, None, None, None)]
    raw = spark.createDataFrame(rows, "`ID Клиента` string, Date string, freq_per_month string, quantity string, avg_check string").withColumn("amount", F.lit("7"))
    df = scoring.profile_features(scoring.profile_rfm(scoring.standardise_input(raw), F.lit("2024-01-15").cast("timestamp")))
    got = {r["client_id"]: r for r in df.collect()}
    assert (got["1"]["recency"], got["1"]["frequency"], got["1"]["monetary"]) == (5, 2.0, 100.0)
    assert (got["2"]["recency"], got["2"]["frequency"], got["2"]["monetary"]) == (365, 4.0, 7.0)
    assert got["3"]["frequency"] == 1.0 and got["3"]["activity_period"] == 1


@pytest.fixture(scope="module")
def bundle(spark):
    rows = [(i, i % 30, 5 + i % 7, 10.0 * (i % 30), 10.0 + i % 4, i % 30 > 15) for i in range(200)]
    df = spark.createDataFrame(rows, "client_id long, recency long, frequency long, monetary double, avg_purchase double, late boolean")
    df = df.withColumn("loyalty_target", F.col("late").cast("int"))
    clustering = fit_clusters(df.drop("late", "loyalty_target"), k=2, starts=1)
    projection = fit_projection(df.drop("late", "loyalty_target"), 2)
    names = ["recency", "frequency", "monetary", "cluster", "pca_component_1"]
    fitted = Loyalty(clustering, projection, [0.0, 1.0], {"Отток": 0, "Высоколояльные": 1})
    table = assemble(projection.apply(clustering.apply(df)), names, "loyalty_target")
    model = custom_spec("forest", numTrees=5).fit(table)
    return scoring.Bundle("forest", model, names, {0: "Отток", 1: "Высоколояльные"}, fitted, Encoder({"M": 0}, ["s"]), None), df, table


def test_bundle_round_trip_serves_like_training(spark, bundle, tmp_path):
    made, df, table = bundle
    path = str(tmp_path / "bundle")
    with pytest.raises(FileNotFoundError):
        scoring.Bundle.load(path)
    made.save(path)
    loaded = scoring.Bundle.load(path)
    served = scoring.score_customers(df, loaded)
    trained = made.model.transform(table).select(F.col("client_id").cast("string").alias("client_id"), "prediction")
    both = served.join(trained, "client_id")
    assert both.count() == 200 and both.filter("segment_id != prediction").isEmpty()
    row = served.first()
    assert set(row["probabilities"]) == {"Отток", "Высоколояльные"} and sum(row["probabilities"].values()) == pytest.approx(1, abs=1e-3)


def test_profiles_with_missing_columns_are_scored(spark, bundle):
    raw = spark.createDataFrame([("9", "?")], "client_id string, gender string")
    row = scoring.score_profiles(raw, bundle[0], "2024-01-01").first()
    assert row["client_id"] == "9" and row["segment_name"] in ("Отток", "Высоколояльные")


def test_alias_order():
    assert schema.ALIASES["last_check_date"][0] == "Дата последнего чека"


def test_run_saves_and_resumes(spark, tmp_path):
    """The resumed run starts from the stored loyalty table and picks the same features."""
    from retentio.plans.run import run
    from retentio.sources import retail

    small = dict(starts=1, repeats=1, shap_draws=1, custom={"logistic_regression": {"maxIter": 10}}, names=["logistic_regression"])
    out = str(tmp_path / "out")
    first = run(retail.transactions(spark, "/root/testdata/sf0.001"), out, retail.PRODUCT_RULES, save_stages=True, **small)
    again = run(None, out, resume=("loyalty",), **small)
    assert first.data.features == again.data.features and first.bundle.name == again.bundle.name
    assert scoring.Bundle.load(f"{out}/best_model").features == first.data.features
    with pytest.raises(FileNotFoundError):
        run(None, str(tmp_path / "none"), resume=("preprocess",), **small)


def test_served_cleaning_fits_nothing_anew(spark):
    """Saved and reloaded, the cleaning gives training's rows; new rows take the saved fills and fences."""
    from retentio.operators.customers import aggregate_customers
    from retentio.plans.serving import fit_serving, load_serving, save_serving
    from retentio.plans.stages import cleaned, fit_cleaning
    from retentio.session import scratch_path
    from retentio.sources import retail

    tx = retail.transactions(spark, "/root/testdata/sf0.001").cache()
    cleaning = fit_cleaning(tx, retail.PRODUCT_RULES)
    customers = aggregate_customers(cleaned(cleaning))
    trained, serving = fit_serving(cleaning, customers)
    path = scratch_path(spark, "serving")
    save_serving(serving, path)
    loaded = load_serving(spark, path)
    assert loaded.as_of == serving.as_of and loaded.rfm == serving.rfm
    columns = sorted(cleaned(cleaning).columns)

    def rows(df):
        return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)

    assert rows(loaded.clean(tx)) == rows(cleaned(cleaning))
    assert sorted(loaded.customers(tx).collect(), key=str) == sorted(trained.select(*loaded.customers(tx).columns).collect(), key=str)

    fence = cleaning.fences["amount"].high
    new = tx.limit(20).withColumn("amount", F.lit(fence * 1000.0)).withColumn("gender", F.lit(None).cast("string"))
    served = loaded.clean(new).collect()
    scaled_high = cleaning.scaler.expression("amount")
    top = spark.createDataFrame([(fence,)], "amount double").select(scaled_high.alias("x")).first()["x"]
    assert all(abs(r["amount"] - top) < 1e-9 for r in served)  # cut at the saved fence, then the saved scale
    if "gender" in cleaning.imputer.values:
        assert all(r["gender"] == cleaning.imputer.values["gender"] for r in served)  # the saved mode


def test_bundle_without_serving_refuses_purchases(spark):
    bundle = scoring.Bundle("m", None, [], {}, None, Encoder(), None)
    with pytest.raises(ValueError):
        scoring.score_purchases(spark.createDataFrame([], "client_id long"), bundle)
