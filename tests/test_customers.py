import datetime as dt

import pytest
from pyspark.sql import functions as F

from retentio.operators import categories, customers, loyalty, rfm

D = dt.datetime


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        (1, D(2024, 1, 1, 10), 100.0, 0.0, 5.0, 1, "a"),
        (2, D(2024, 1, 5, 9), 10.0, 2.0, 1.0, 0, "b"),
        (2, D(2024, 1, 5, 18), 30.0, 2.0, 1.0, 1, "a"),
        (3, D(2024, 1, 1), 1.0, 1.0, 0.0, 0, "a"),
        (3, D(2024, 1, 9), None, 1.0, 0.0, 0, "a"),
        (None, D(2024, 1, 10), 7.0, 1.0, 0.0, 0, "a"),
    ]
    df = spark.createDataFrame(
        rows, "client_id long, purchase_ts timestamp_ntz, amount double, bonus_earned double, bonus_spent double, gender_code int, product_category string"
    )
    for name in ("a", "b"):
        df = df.withColumn(f"product_{name}", (F.col("product_category") == name).cast("int"))
    return {r["client_id"]: r for r in customers.aggregate_customers(df).collect()}


def test_null_key_is_dropped(table):
    assert set(table) == {1, 2, 3}


def test_single_purchase_has_no_deviation(table):
    assert table[1]["amount_std"] is None and table[1]["frequency"] == 1


def test_same_day_counts_as_one_day(table):
    assert table[2]["activity_period"] == 1 and table[2]["purchase_frequency"] == 2


def test_recency_in_whole_days(table):
    # the last purchase of all belongs to customer 3, at midnight of the 9th
    assert [table[k]["recency"] for k in (1, 2, 3)] == [7, 3, 0]


def test_zero_earned_counts_as_one(table):
    assert table[1]["bonus_usage_ratio"] == 5.0


def test_first_values(table):
    assert table[2]["gender_code"] == 0 and table[2]["product_category"] == "b"
    assert table[2]["product_a"] == 0.5


def test_missing_key_column_is_an_error(spark):
    with pytest.raises(ValueError):
        customers.aggregate_customers(spark.range(3))


def test_ties_at_a_quartile_share_a_score(spark):
    rows = [(i, v, v, float(v)) for i, v in enumerate([1, 1, 1, 2, 2, 3, 4, 4])]
    df = spark.createDataFrame(rows, "client_id int, recency long, frequency long, monetary double")
    got = rfm.apply_rfm(df, rfm.fit_cuts(df)).collect()
    by_value = {r["frequency"]: (r["R"], r["F"], r["M"]) for r in got}
    assert len({(r["frequency"], r["R"], r["F"], r["M"]) for r in got}) == 4
    assert by_value[1] == (4, 1, 1) and by_value[4] == (1, 4, 4)


def test_rfm_without_metrics(spark):
    with pytest.raises(ValueError):
        rfm.fit_cuts(spark.range(2))


def test_sparse_columns_and_incomplete_rows_go(spark):
    rows = [(i, i, i, float(i), None if i < 4 else 1.0, None if i == 9 else 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "client_id int, recency long, frequency long, monetary double, rare double, std double")
    out = rfm.prepare_customers(df)
    assert "rare" not in out.columns and out.count() == 9


def test_second_pass_uses_survivors(spark):
    rows = [(i, i, i, float(i), None if i >= 6 else 1.0) for i in range(8)] + [(8, 8, 8, 8.0, 1.0)]
    df = spark.createDataFrame(rows, "client_id int, recency long, frequency long, monetary double, std double")
    first = {r["client_id"]: r["F"] for r in rfm.prepare_customers(df).collect()}
    second = {r["client_id"]: r["F"] for r in rfm.two_pass_rfm(df).collect()}
    assert set(first) == set(second) and first != second


def test_gini_and_score_bounds(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1, 1, 1), (0.5, 0.5, 4, 4, 4), (1.0, 0.0, 2, 3, 1)], "product_a double, product_b double, R int, F int, M int")
    out = loyalty.add_score(loyalty.add_features(df, parity=False)).collect()
    assert [r["product_gini"] for r in out] == pytest.approx([0.0, 0.5, 0.0])
    assert [r["product_categories"] for r in out] == [0, 2, 1]
    assert all(0 <= r["loyalty_score"] <= 1 for r in out)


def test_equal_boundaries_fall_to_the_last_category(spark):
    df = spark.createDataFrame([(0.3,), (1.0,), (0.9999,)], "loyalty_score double")
    got = [r["loyalty_category"] for r in categories.categorise(df, [0, 1.0, 1.0, 1.0, 1.0, 1.0]).collect()]
    assert got == ["Отток", "Высоколояльные", "Отток"]


def test_manual_boundaries_are_checked(spark):
    with pytest.raises(ValueError):
        categories.fit_boundaries(spark.range(1), "manual", 5, [0, 1])
    with pytest.raises(ValueError):
        categories.optimise_boundaries(spark.range(1), [10, 10])


def test_one_category_is_not_balanced(spark):
    df = spark.createDataFrame([("a",), ("a",)], "loyalty_category string")
    row = categories.evaluate_distribution(df).first()
    assert row["normalized_entropy"] == 0 and not row["is_balanced"]
