import datetime as dt

import pytest
from pyspark.sql import functions as F

from retentio.sources import retail

TABLES = {
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(1, "N1", 0), (2, "N2", 4)]),
    "customer": (
        "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        [(1, "c", 1, 10.0, "BUILDING"), (2, "c", 2, -950.0, "MACHINERY"), (2, "c", 1, 7.0, "FURNITURE"), (None, "c", 1, 1.0, "X")],
    ),
    "part": (
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
        [(1, "old ring", "b", "PROMO", 1, 1.0), (2, "new bolt", "b", None, 1, 1.0)],
    ),
    "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(1, "S1", 1, 0.0)]),
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
        [
            (1, 1, "O", 1.0, dt.datetime(2024, 1, 1), "5-LOW"),
            (2, 2, "O", 1.0, dt.datetime(2024, 3, 1), "1-URGENT"),
            (2, 1, "O", 1.0, dt.datetime(2024, 4, 1), None),
            (3, None, "O", 1.0, dt.datetime(2024, 4, 1), "1-URGENT"),
        ],
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string",
        [
            (1, 1, 1, 1, 50.0, 100.0, 0.1, 0.2, "R"),
            (1, 2, 1, 2, 1.0, 200.0, 0.1, 0.2, None),
            (2, 1, 1, 1, 3.0, 300.0, 0.1, 0.2, "N"),
            (2, 9, 1, 2, 3.0, 400.0, 0.1, 0.2, "N"),
            (3, 1, 1, 1, 3.0, 500.0, 0.1, 0.2, "N"),
            (None, 1, 1, 1, 3.0, 500.0, 0.1, 0.2, "N"),
        ],
    ),
}


@pytest.fixture
def folder(spark, tmp_path):
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_transactions_with_repeated_and_null_keys(spark, folder):
    found = retail.transactions(spark, folder)
    got = sorted(((r["client_id"], r["order_key"], r["line_number"], r["gender"], r["store"], r["amount"], r["bonus_spent"],
                  r["balance_accrued"], r["balance_gift"], r["avg_check"], r["card_date"]) for r in found.collect()), key=str)
    jan, mar = dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 1)
    assert [g[:6] for g in got if g[0] == 1] == [
        (1, 1, 1, "BUILDING", "S1", None), (1, 1, 2, "BUILDING", None, 200.0), (1, 2, 1, "BUILDING", "S1", 300.0)
    ]
    # lines without a part stay in the customer facts: (200 + 300 + 400) / 3
    assert [g[6:] for g in got if g[0] == 1] == [(10.0, 20.0, 1.0, 300.0, None), (0.0, 50.0, 0.0, 300.0, None), (0.0, 70.0, 3.0, 300.0, None)]
    # customer 2 has two rows, so its line comes twice
    assert sorted((g[3] or "", g[7], g[10]) for g in got if g[0] == 2) == [("", -890.0, mar), ("FURNITURE", 67.0, mar)]
    assert len(got) == 5 and jan not in [g[10] for g in got]


def test_purchase_rows_move_once_by_customer(spark, folder, no_broadcast):
    """Facts and customers meet before the purchase rows do, which are then shuffled by customer once."""
    plan = retail.transactions(spark, folder)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(o_custkey" in line or "Exchange hashpartitioning(client_id" in line]
    assert len([line for line in moved if "ENSURE_REQUIREMENTS" in line]) <= 3, plan


def test_facts_are_summed_per_order_before_the_join(spark, tmp_path):
    """Only one row per order meets the orders; before, every line did."""
    for name in ("lineitem", "orders"):
        schema, rows = TABLES[name]
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    facts = retail.client_facts(spark, str(tmp_path))
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :]
    assert "Aggregate [l_orderkey" in below
    got = {r["client_id"]: (r["purchase_days"], r["freq_per_month"], r["avg_check"]) for r in facts.collect()}
    assert got == {
        1: (2.0, 4 / (91 / 30), pytest.approx(300.0)),
        2: (1.0, 2.0, pytest.approx(350.0)),
        None: (1.0, 1.0, pytest.approx(500.0)),
    }


def _last_joins(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Join [" in line][:2]


def test_names_join_after_the_customers(spark, folder):
    """Where Spark sends part and supplier to the rows, their texts come last and no shuffle carries them."""
    joins = _last_joins(retail.transaction_rows(spark, folder))
    assert "s_suppkey" in joins[0] and "p_partkey" in joins[1], joins


def test_names_join_before_the_customers_where_they_move_the_rows(spark, folder, no_broadcast):
    joins = _last_joins(retail.transaction_rows(spark, folder))
    assert "c_custkey" in joins[0] and "s_suppkey" in joins[1], joins


def test_the_written_purchase_table_holds_raw_fields(spark, folder, monkeypatch):
    from checks import stages

    columns, plain = [], stages.materialize
    monkeypatch.setattr(stages, "materialize", lambda df, *a: columns.append(df.columns) or plain(df, *a))
    got, wanted = stages.tx(spark, folder), retail.transactions(spark, folder)
    assert len(columns) == 1 and not {"external_discount", "bonus_earned", "balance_accrued", "balance_gift"} & set(columns[0])
    assert got.dtypes == wanted.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


def test_each_dimension_joins_where_its_own_size_puts_it(spark, folder, tmp_path):
    """Before, a part table that moves the rows also put the supplier's texts into the shuffle by customer."""
    wide = F.concat(F.lit("part "), F.md5(F.col("id").cast("string")))
    numbers = spark.range(3000)
    numbers.select(F.col("id").alias("p_partkey"), wide.alias("p_name"), F.lit("PROMO").alias("p_type")).write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
    one = spark.createDataFrame(TABLES["lineitem"][1][:1], TABLES["lineitem"][0])
    numbers.withColumn("l_extendedprice", F.rand(1)).withColumn("l_partkey", F.col("id")).drop("id").crossJoin(one.drop("l_extendedprice", "l_partkey")).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "4k")
    try:
        joins = _last_joins(retail.transaction_rows(spark, folder))
    finally:
        spark.conf.set(name, before)
    assert "s_suppkey" in joins[0] and "c_custkey" in joins[1], joins


def test_order_sums_move_once_by_customer(spark, folder, no_broadcast):
    plan = retail.client_facts(spark, folder)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(client_id" in line]
    assert len(moved) == 1, plan


def test_the_purchase_table_is_not_shuffled_by_customer_again(spark, folder, no_broadcast, monkeypatch):
    """Before, medians, filled rows and sums per customer each shuffled the written rows by customer."""
    from checks import stages
    from retentio.operators import impute

    plans, plain = {}, impute.materialize

    def recorded(df, label="stage", *args):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, label, *args)

    monkeypatch.setattr(impute, "materialize", recorded)
    clean = stages.clean(spark, folder)
    sums = clean.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    plans["sums"] = sums._jdf.queryExecution().executedPlan().toString()
    moved = {label: plan.count("Exchange hashpartitioning(") for label, plan in plans.items()}
    # the medians, not the rows, are moved to the rows that lack a value
    assert moved == {"customer-medians": 0, "filled": 1, "sums": 0}, plans
    assert {r["client_id"]: r["n"] for r in sums.collect()} == {1: 3, 2: 2}
    assert clean.filter(F.col("amount").isNull()).count() == 0


def test_bucketed_tables_keep_their_rows_and_the_session(spark):
    from retentio.session import materialize

    rows = [(i % 7 if i % 5 else None, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "client_id long, amount double")
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    got = materialize(df, "bucketed", "zstd", "client_id")
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect())) and got.dtypes == df.dtypes
    assert spark.conf.get(name) == before
