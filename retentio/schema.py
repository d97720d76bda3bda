"""Names and types of the transaction table and its scoring variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Headers of the raw file (the amount header starts with a Latin C).
HEADERS = {
    "Клиент": "client_id",
    "Пол": "gender",
    "Точка продаж где оформлена карта": "card_store",
    "Дата оформления карты": "card_date",
    "Дата покупки": "purchase_ts",
    "Точка продаж": "store",
    "Название товара": "product_name",
    "Cумма покупки": "amount",
    "Количество": "quantity",
    "Скидка внешняя": "external_discount",
    "Начислено бонусов": "bonus_earned",
    "Списано бонусов": "bonus_spent",
    "Дата первого чека": "first_check_date",
    "Дата последнего чека": "last_check_date",
    "Покупок, в днях": "purchase_days",
    "Частота, раз/мес": "freq_per_month",
    "Средняя сумма покупок": "avg_check",
    "Баланс накопленный": "balance_accrued",
    "Баланс подарочный": "balance_gift",
}

TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("client_id", T.LongType()),
        T.StructField("gender", T.StringType()),
        T.StructField("card_store", T.StringType()),
        T.StructField("card_date", T.TimestampType()),
        T.StructField("purchase_ts", T.TimestampType()),
        T.StructField("store", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("quantity", T.LongType()),
        T.StructField("external_discount", T.DoubleType()),
        T.StructField("bonus_earned", T.DoubleType()),
        T.StructField("bonus_spent", T.DoubleType()),
        T.StructField("first_check_date", T.TimestampType()),
        T.StructField("last_check_date", T.TimestampType()),
        T.StructField("purchase_days", T.DoubleType()),
        T.StructField("freq_per_month", T.DoubleType()),
        T.StructField("avg_check", T.DoubleType()),
        T.StructField("balance_accrued", T.DoubleType()),
        T.StructField("balance_gift", T.DoubleType()),
    ]
)

# Column roles of the cleaning stage.
DATE_COLUMNS = ["card_date", "first_check_date", "last_check_date"]
MONEY_COLUMNS = ["amount", "bonus_earned", "bonus_spent", "avg_check", "balance_accrued", "balance_gift"]
RATE_COLUMNS = ["freq_per_month", "purchase_days"]
FILL_COLUMNS = [
    "amount",
    "bonus_earned",
    "bonus_spent",
    "avg_check",
    "freq_per_month",
    "balance_accrued",
    "balance_gift",
    "purchase_days",
]
OUTLIER_COLUMNS = [
    "amount",
    "bonus_earned",
    "bonus_spent",
    "avg_check",
    "freq_per_month",
    "balance_accrued",
    "balance_gift",
]
CATEGORY_COLUMNS = ["store", "card_store", "product_name"]
UNKNOWN = "Неизвестно"

# Input names accepted at scoring, first present one wins.
ALIASES = {
    "client_id": ["Клиент", "client_id", "ID Клиента"],
    "gender": ["Пол", "gender"],
    "store": ["Точка продаж", "store", "Purchase Store"],
    "last_check_date": ["Дата последнего чека", "last_check_date", "Дата покупки", "Purchase Date", "Date"],
    "first_check_date": ["Дата первого чека", "first_check_date", "First Purchase Date"],
    "amount": ["Cумма покупки", "amount"],
    "quantity": ["Количество", "quantity"],
    "bonus_earned": ["Начислено бонусов", "bonus_earned"],
    "bonus_spent": ["Списано бонусов", "bonus_spent"],
    "freq_per_month": ["Частота, раз/мес", "freq_per_month"],
    "avg_check": ["Средняя сумма покупок", "avg_check"],
}


def rename_headers(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(HEADERS.get(c, c)) for c in df.columns])


def resolve_aliases(df: DataFrame) -> DataFrame:
    """Engine names for the first alias found of each scoring column; the rest is kept."""
    chosen = {}
    for name, options in ALIASES.items():
        source = next((o for o in options if o in df.columns), None)
        if source is not None:
            chosen[name] = source
    renamed = [F.col(f"`{source}`").alias(name) for name, source in chosen.items()]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in chosen.values() and c not in chosen]
    return df.select(*renamed, *rest)
