"""Categorical encodings; fitted mappings are small and JSON-ready."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio import schema
from retentio.operators.profile import top_by_count

LABEL_LIMIT = 10_000

# Product groups of the clothing catalogue, first match wins.
CLOTHING_RULES = [
    ("Верхняя одежда", ["куртка", "пальто"]),
    ("Футболки", ["футболка", "майка"]),
    ("Брюки", ["брюки", "джинсы"]),
    ("Платья", ["платье"]),
    ("Юбки", ["юбка"]),
    ("Рубашки", ["рубашка", "блуза"]),
    ("Костюмы", ["костюм"]),
    ("Аксессуары", ["аксессуар"]),
]
OTHER_PRODUCT = "Другое"


@dataclass
class Encoder:
    gender_codes: dict[str, int] = field(default_factory=dict)
    top_stores: list[str] = field(default_factory=list)
    product_rules: list = field(default_factory=lambda: CLOTHING_RULES)

    @property
    def store_columns(self) -> list[str]:
        return [*named_stores(self.top_stores).values(), "location_other"]

    @property
    def product_columns(self) -> list[str]:
        return [product_column(c) for c in self.product_categories]

    @property
    def product_categories(self) -> list[str]:
        return [name for name, _ in self.product_rules] + [OTHER_PRODUCT, schema.UNKNOWN]


def fit_labels(df: DataFrame, column: str) -> dict[str, int]:
    """Codes 0..k-1 in lexicographic order of the distinct values."""
    values = df.filter(F.col(column).isNotNull()).select(column).distinct().limit(LABEL_LIMIT + 1).collect()
    if len(values) > LABEL_LIMIT:
        raise ValueError(f"{column} has more than {LABEL_LIMIT} labels; it is not a category")
    return {v: i for i, v in enumerate(sorted(row[0] for row in values))}


def label_code(column: Column, codes: dict[str, int]) -> Column:
    """Code of each value; an unseen or missing value takes the first label's code."""
    if not codes:
        return F.lit(0)
    mapping = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    # a map is null for unknown keys, and the map itself may not be probed with null
    known = F.try_element_at(mapping, F.coalesce(column.cast("string"), F.lit("")))
    return F.coalesce(known, F.lit(next(iter(codes.values()))))


def store_column(name: str) -> str:
    # fixed values: the characters that become _ or vanish in a store's column
    return "location_" + name.replace(" ", "_").replace(",", "").replace(".", "").replace("/", "_")


def named_stores(stores: list[str]) -> dict[str, str]:
    """Column of each store; stores whose names come out alike (or as "other") are numbered."""
    names: dict[str, str] = {}
    for store in stores:
        name, k = store_column(store), 2
        while name in names.values() or name == "location_other":
            name, k = f"{store_column(store)}_{k}", k + 1
        names[store] = name
    return names


def product_column(name: str) -> str:
    return f"product_{name}"


def product_category(name: Column, rules=CLOTHING_RULES) -> Column:
    lowered = F.lower(name)
    chain = F.when(name.isNull(), F.lit(schema.UNKNOWN))
    for category, words in rules:
        hit = F.contains(lowered, F.lit(words[0]))
        for word in words[1:]:
            hit = hit | F.contains(lowered, F.lit(word))
        chain = chain.when(hit, F.lit(category))
    return chain.otherwise(F.lit(OTHER_PRODUCT))


def fit_encoder(df: DataFrame, stores: int = 10, product_rules=CLOTHING_RULES) -> Encoder:
    encoder = Encoder(product_rules=product_rules)
    if "gender" in df.columns:
        encoder.gender_codes = fit_labels(df, "gender")
    if "store" in df.columns:
        encoder.top_stores = [row["store"] for row in top_by_count(df, "store", stores).collect()]
    return encoder


def apply_encoder(df: DataFrame, encoder: Encoder) -> DataFrame:
    added = {}
    if "gender" in df.columns:
        added["gender_code"] = label_code(F.col("gender"), encoder.gender_codes)
    if "store" in df.columns:
        store = F.coalesce(F.col("store"), F.lit(""))
        for s, name in named_stores(encoder.top_stores).items():
            added[name] = (store == s).cast("int")
        added["location_other"] = (~store.isin(encoder.top_stores)).cast("int")
    if "product_name" in df.columns:
        added["product_category"] = product_category(F.col("product_name"), encoder.product_rules)
    encoded = df.withColumns(added)
    if "product_category" not in added:
        return encoded
    # a second step, so that the rules run once a row and not once a flag
    flags = {product_column(n): (F.col("product_category") == n).cast("int") for n in encoder.product_categories}
    return encoded.withColumns(flags)


def to_number(column: Column, default: float) -> Column:
    """Text to double; what does not parse becomes the default."""
    return F.coalesce(column.cast("string").try_cast("double"), F.lit(float(default)))
