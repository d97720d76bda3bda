import datetime as dt

import pytest
from pyspark.sql import functions as F

from retentio.operators import encode, impute, profile, scaling

D = dt.datetime


def test_customer_then_global_median(spark):
    rows = [(1, 10.0), (1, 20.0), (1, None), (2, None), (2, None), (3, 50.0)]
    df = spark.createDataFrame(rows, "client_id long, amount double")
    fitted = impute.fit_imputer(df)
    got = sorted((r["client_id"], r["amount"]) for r in fitted.apply(df).collect())
    # customer 1 takes its own median; the global one is taken after that fill: 10 15 20 50
    assert got == [(1, 10.0), (1, 15.0), (1, 20.0), (2, 17.5), (2, 17.5), (3, 50.0)]


def test_dates_fill_by_customer(spark):
    rows = [(1, D(2024, 1, 1)), (1, D(2024, 1, 3)), (1, None), (2, None)]
    df = spark.createDataFrame(rows, "client_id long, card_date timestamp_ntz")
    got = sorted((r["client_id"], r["card_date"]) for r in impute.fit_imputer(df).apply(df).collect())
    assert got == [(1, D(2024, 1, 1)), (1, D(2024, 1, 2)), (1, D(2024, 1, 3)), (2, D(2024, 1, 2))]


def test_sparse_category_takes_mode_dense_takes_unknown(spark):
    rows = [("a" if i % 2 else "b", None if i == 0 else "s", None if i < 10 else "p") for i in range(100)]
    df = spark.createDataFrame(rows, "gender string, store string, product_name string").withColumn("client_id", F.lit(1))
    fitted = impute.fit_imputer(df)
    assert fitted.values == {"store": "s", "product_name": "Неизвестно"}


def test_mode_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "gender string")
    assert impute.modes(df, ["gender"]) == {"gender": "a"}


def test_all_null_column_stays_null(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "client_id long, amount double")
    assert [r["amount"] for r in impute.fit_imputer(df).apply(df).collect()] == [None, None]


def test_lower_fence_cuts_only_when_positive(spark):
    high = spark.createDataFrame([(float(v),) for v in [1, 100, 101, 102, 103, 104, 300]], "amount double")
    fences = scaling.fit_fences(high, ["amount"])
    assert fences["amount"].low > 0
    got = sorted(r[0] for r in scaling.winsorise(high, fences).collect())
    assert got[0] == fences["amount"].low and got[-1] == fences["amount"].high
    low = spark.createDataFrame([(float(v),) for v in [-500, 0, 1, 2, 3, 4, 500]], "amount double")
    assert min(r[0] for r in scaling.winsorise(low, scaling.fit_fences(low, ["amount"])).collect()) == -500


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(5.0, 2.0, 1.0), (5.0, 2.0, 3.0), (None, 2.0, 2.0)], "a double, b double, c double")
    got = scaling.fit_scaler(df, ["a", "c"], ["b"]).apply(df).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0, 0.0), (0.0, 0.0, 1.0), (None, 0.0, 0.5)]


def test_codes_stores_and_categories(spark):
    rows = [("M", "ТЦ Юг, д.1/2", "Куртка зимняя"), ("Ж", "B", "джинсы"), ("M", "B", "шапка"), ("M", "C", None)]
    df = spark.createDataFrame(rows, "gender string, store string, product_name string")
    encoder = encode.fit_encoder(df, stores=2)
    assert encoder.gender_codes == {"M": 0, "Ж": 1}
    assert encoder.top_stores == ["B", "C"]
    assert encode.store_column("ТЦ Юг, д.1/2") == "location_ТЦ_Юг_д1_2"
    out = encode.apply_encoder(df, encoder).collect()
    assert [r["product_category"] for r in out] == ["Верхняя одежда", "Брюки", "Другое", "Неизвестно"]
    assert [r["location_other"] for r in out] == [1, 0, 0, 0]
    unseen = spark.createDataFrame([("X",), (None,), ("Ж",)], "gender string")
    assert [r[0] for r in unseen.select(encode.label_code(F.col("gender"), encoder.gender_codes)).collect()] == [0, 0, 1]


def test_profile_of_edge_columns(spark):
    df = spark.createDataFrame([(1.0, 1.0, "x"), (2.0, 1.0, "x"), (None, 1.0, None)], "a double, b double, s string")
    missing = {r["column"]: r["missing"] for r in profile.missing_profile(df).collect()}
    assert missing == {"a": 1, "s": 1}
    r = {(x["a"], x["b"]): x["r"] for x in profile.correlation_matrix(df, ["a", "b"]).collect()}
    assert r[("a", "a")] == pytest.approx(1.0) and r[("a", "b")] is None
    twice = df.unionByName(df)
    assert profile.duplicate_rows(twice).first()["duplicates"] == 3


def test_number_and_date_coercion(spark):
    df = spark.createDataFrame([("12.5", "2024-01-05"), ("x", "31/12/2023"), (None, "?")], "n string, d string")
    from retentio.functions.columns import parse_timestamp

    got = df.select(encode.to_number(F.col("n"), 1), parse_timestamp(F.col("d"), "dd/MM/yyyy").cast("date")).collect()
    assert [tuple(r) for r in got] == [(12.5, dt.date(2024, 1, 5)), (1.0, dt.date(2023, 12, 31)), (1.0, None)]


def test_only_rows_with_a_gap_are_written_again(spark, monkeypatch):
    rows = [(1, 10.0, "a"), (1, None, None), (1, 20.0, "a"), (2, None, "b"), (3, 5.0, None), (None, None, "a"), (1, 20.0, "a")]
    df = spark.createDataFrame(rows, "client_id long, amount double, gender string")
    fitted, written, plain = impute.fit_imputer(df), [], impute.materialize

    def recorded(table, *args):
        made = plain(table, *args)
        written.append(made.count())
        return made

    monkeypatch.setattr(impute, "materialize", recorded)
    got = fitted.apply_staged(df)
    assert written == [3]
    assert sorted(map(str, got.collect())) == sorted(map(str, fitted.apply(df).collect()))


def test_cleaning_does_not_write_the_whole_filled_table(spark, monkeypatch):
    from retentio.plans import stages

    labels = []
    monkeypatch.setattr(stages, "materialize", lambda table, label="stage", *a: labels.append(label) or table)
    rows = [(1, 10.0 + i, "a", D(2024, 1, 1 + i)) for i in range(5)]
    df = spark.createDataFrame(rows, "client_id long, amount double, gender string, purchase_ts timestamp_ntz")
    fitted = stages.fit_cleaning(df)
    assert labels == [] and fitted.filled.count() == 5


def test_customer_medians_are_taken_in_sorted_order(spark, monkeypatch):
    """Rows sorted by customer by the join are not put into a hash table of all customers' values, which spills."""
    plans, plain = [], impute.materialize

    def recorded(table, label="stage", *args):
        if label == "customer-medians":
            plans.append(table._jdf.queryExecution().executedPlan().toString())
        return plain(table, label, *args)

    monkeypatch.setattr(impute, "materialize", recorded)
    limit, name = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.execution.replaceHashWithSortAgg"
    before, kept = spark.conf.get(limit), spark.conf.get(name)
    spark.conf.set(limit, "-1")
    try:
        rows = [(1, 10.0), (1, None), (1, 20.0), (2, None), (3, 5.0), (None, 7.0), (1, 40.0)]
        fitted = impute.fit_imputer(spark.createDataFrame(rows, "client_id long, amount double"))
    finally:
        spark.conf.set(limit, before)
    assert "SortAggregate" in plans[0] and "ObjectHashAggregate" not in plans[0], plans[0]
    assert {r["client_id"]: r["amount"] for r in fitted.customer_medians.collect()} == {1: 20.0, 2: None}
    assert spark.conf.get(name) == kept
