"""Transaction view over the star-schema tables (see FIXTURES.md for the mapping)."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.functions.columns import whole_days
from retentio.session import prepare

# Product groups of this catalogue: category -> substrings, first match wins.
PRODUCT_RULES = [
    ("Rings", ["ring"]),
    ("Fasteners", ["bolt", "rod"]),
    ("Plates", ["plate"]),
    ("Gears", ["gear"]),
    ("Gizmos", ["gizmo"]),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Purchase lines with the customer key and the fields no dimension is needed for."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    price = F.col("l_extendedprice")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("client_id"),
        F.col("o_orderdate").alias("purchase_ts"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        "l_partkey",
        "l_suppkey",
        "o_orderpriority",
        F.when(F.col("l_quantity") != 50, price).alias("amount"),
        F.col("l_quantity").cast("long").alias("quantity"),
        (price * F.col("l_discount")).alias("external_discount"),
        (price * F.col("l_tax")).alias("bonus_earned"),
        F.when(F.col("l_returnflag") == "R", price * F.col("l_discount")).otherwise(0.0).alias("bonus_spent"),
        price.alias("l_extendedprice"),
    )


FACTS = ["first_check_date", "last_check_date", "purchase_days", "freq_per_month", "avg_check"]


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions without the per-customer facts that the raw file repeats on every row."""
    return _purchases(_raw_rows(spark, folder, clients(spark, folder)), ["o_orderpriority"], [])


def clients(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with the name and region of their nation."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


def _moves_the_lines(lines: DataFrame, other: DataFrame, condition: Column) -> bool:
    """Whether Spark, by its own estimates, moves the lines to join ``other`` and does not send it to them."""
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        lines.join(other, condition).explain()
    return bool(re.search("SortMergeJoin|ShuffledHashJoin", plan.getvalue()))


def _raw_rows(spark: SparkSession, folder: str, client: DataFrame) -> DataFrame:
    """Raw fields of the purchase rows: lines joined with order, part, supplier and ``client``.

    Lines meet their order first, while they hold numbers only, and the one join by customer
    leaves the rows grouped by customer. A dimension (part, supplier) that Spark joins without
    moving the lines comes after that, so no shuffle carries its texts; one that moves them comes
    before it, so that the customer's fields do not travel with the lines.
    """
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_returnflag") == "R").alias("_returned"),
    )
    part = table(spark, folder, "part").select("p_partkey", "p_name", (F.col("p_type") == "PROMO").alias("_promo"))
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", (F.col("o_orderpriority") != "5-LOW").alias("_carded")
    )
    names = [(part, F.col("l_partkey") == F.col("p_partkey")), (supplier, F.col("l_suppkey") == F.col("s_suppkey"))]
    owner = [(client, F.col("o_custkey") == F.col("c_custkey"))]
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    first = [name for name in names if _moves_the_lines(lines, *name)]
    for other, condition in first + owner + [name for name in names if name not in first]:
        rows = rows.join(other, condition)
    return rows


def _purchases(rows: DataFrame, before: list[str], after: list[str]) -> DataFrame:
    """Purchase columns from raw fields; ``before`` and ``after`` the row's keys, columns kept as they are."""
    price = F.col("l_extendedprice")
    return rows.select(
        F.col("o_custkey").alias("client_id"),
        F.when(F.col("c_acctbal") >= -900, F.col("c_mktsegment")).alias("gender"),
        F.when(F.col("n_regionkey") != 4, F.col("n_name")).alias("card_store"),
        F.col("o_orderdate").alias("purchase_ts"),
        F.when(F.col("l_quantity").cast("long") != 1, F.col("s_name")).alias("store"),
        F.col("p_name").alias("product_name"),
        F.when(F.col("l_quantity") != 50, price).alias("amount"),
        F.col("l_quantity").cast("long").alias("quantity"),
        (price * F.col("l_discount")).alias("external_discount"),
        (price * F.col("l_tax")).alias("bonus_earned"),
        F.when(F.col("_returned"), price * F.col("l_discount")).otherwise(0.0).alias("bonus_spent"),
        (
            F.col("c_acctbal")
            + price * F.col("l_tax")
            - F.when(F.col("_returned"), price * F.col("l_discount")).otherwise(0.0)
        ).alias("balance_accrued"),
        F.when(F.col("_promo"), price * 0.01).otherwise(0.0).alias("balance_gift"),
        *before,
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("part_key"),
        *after,
    )


def client_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Denormalised customer facts: one row per customer, from sums per order.

    Lines are summed by order key before they meet the orders, so the join and the distinct
    dates see one row per order and not one per line. These rows move once, by customer, which
    serves the distinct dates, the sums and the join with the customers.
    """
    amount = F.when(F.col("l_quantity") != 50, F.col("l_extendedprice"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", amount.alias("amount"))
    summed = lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("_lines"), F.count("amount").alias("_known"), F.sum("amount").alias("_amount")
    )
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("client_id"), F.col("o_orderdate").alias("purchase_ts"))
    months = F.greatest(F.lit(1.0), whole_days(F.max("purchase_ts"), F.min("purchase_ts")) / F.lit(30.0))
    bought = summed.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")
    return bought.repartition("client_id").groupBy("client_id").agg(
        F.min("purchase_ts").alias("first_check_date"),
        F.max("purchase_ts").alias("last_check_date"),
        F.count_distinct("purchase_ts").cast("double").alias("purchase_days"),
        (F.sum("_lines") / months).alias("freq_per_month"),
        F.try_divide(F.sum("_amount"), F.sum("_known")).alias("avg_check"),
    )


RAW_FIELDS = [
    "o_custkey", "c_acctbal", "c_mktsegment", "n_name", "n_regionkey", "o_orderdate", "_carded", "s_name", "p_name", "_promo",
    "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "_returned", *FACTS,
]


def transaction_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What ``as_transactions`` is derived from: the table to write, as raw fields take less room
    than the amounts derived from them."""
    facts = client_facts(spark, folder).withColumnRenamed("client_id", "_client")
    client = clients(spark, folder).join(facts, F.col("c_custkey") == F.col("_client"))
    return _raw_rows(spark, folder, client).select(*RAW_FIELDS)


def as_transactions(rows: DataFrame) -> DataFrame:
    card_date = F.when(F.col("_carded"), F.col("first_check_date")).alias("card_date")
    return _purchases(rows.select("*", card_date), [], [*FACTS, "card_date"])


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """The full 19-column transaction table plus the keys that fix the row order."""
    return as_transactions(transaction_rows(spark, folder))


def event_purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Second, small transaction source with times of day."""
    events = table(spark, folder, "events").filter(F.col("event_type") == "purchase")
    return events.select(
        F.col("user_id").alias("client_id"),
        F.col("ts").alias("purchase_ts"),
        F.col("value").alias("amount"),
        F.col("event_id").alias("order_key"),
    )
