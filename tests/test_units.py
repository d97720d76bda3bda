"""Codes and classes without caps, class names after re-cutting, profile money in training units."""

from pyspark.sql import functions as F

from retentio.models import classifiers
from retentio.operators import encode, sampling
from retentio.operators.customers import decoded, earliest_code
from retentio.operators.scaling import Scaler
from retentio.plans import scoring


def test_large_codes_survive(spark):
    df = spark.sql(
        "SELECT id % 3 AS client, timestamp_micros((id - 5) * 1000000) AS purchase_ts, CAST(3000 + 100000000 * (id % 20) AS INT) AS code FROM range(60)"
    )
    got = df.groupBy("client").agg(earliest_code(F.col("code")).alias("c")).withColumn("c", decoded("c"))
    assert {r.client: r.c for r in got.collect()} == {0: 3000, 1: 100003000, 2: 200003000}


def test_all_classes_are_found(spark):
    assert classifiers.labels(spark.sql("SELECT CAST(id AS DOUBLE) AS label FROM range(1500)")) == list(range(1500))


def test_recut_classes_bring_their_names(spark):
    rows = spark.sql("SELECT id, id / 200.0D AS loyalty_score, CAST(id >= 180 AS INT) AS y FROM range(200)")
    table, label, mapping = sampling.rebalance(rows, "boundary", "y")
    names = sampling.class_names(mapping)
    assert set(names) >= {r[0] for r in table.select(label).distinct().collect()}


def test_profile_money_is_scaled_like_purchases(spark):
    scaler = Scaler({"amount": 100.0, "bonus_earned": 0.0, "freq_per_month": 5.0}, {"amount": 1000.0, "bonus_earned": 50.0, "freq_per_month": 2.0})
    raw = spark.createDataFrame([(1, 1100.0, 600.0, 2.0, 25.0)], "client_id int, amount double, avg_check double, freq_per_month double, bonus_earned double")
    row = scoring.profile_rfm(scoring.training_units(raw, scaler), F.lit("2024-01-01").cast("timestamp")).first()
    assert (row.frequency, row.avg_purchase, row.monetary, row.bonus_earned) == (2.0, 0.5, 1.0, 0.5)


def test_stores_with_like_names_keep_their_columns(spark):
    stores = ["a.b", "ab", "other", "a,b"]
    assert encode.named_stores(stores) == {"a.b": "location_ab", "ab": "location_ab_2", "other": "location_other_2", "a,b": "location_ab_3"}
    flags = encode.apply_encoder(spark.createDataFrame([(s,) for s in [*stores, "new"]], "store string"), encode.Encoder(top_stores=stores))
    assert [sum(row[1:]) for row in flags.collect()] == [1] * 5
