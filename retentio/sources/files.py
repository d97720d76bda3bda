"""Files in and out: CSV, Parquet, JSON, stage tables, prepared datasets, small values."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from retentio import schema
from retentio.functions.columns import nan_to_null


def path_exists(spark: SparkSession, path: str) -> bool:
    """Checked on the file system the path belongs to, local or shared."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def require_path(spark: SparkSession, path: str) -> None:
    if not path_exists(spark, path):
        raise FileNotFoundError(path)


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the input has no rows")
    return df


def read_csv(spark: SparkSession, path: str, types: T.StructType | None = None, infer: bool = False) -> DataFrame:
    """CSV with a header. With a schema the file is read once and columns are pruned."""
    require_path(spark, path)
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    if types is not None:
        reader = reader.schema(types).option("enforceSchema", False)
    elif infer:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Raw purchase file (original or engine headers) with engine names and types."""
    require_path(spark, path)
    raw = schema.rename_headers(spark.read.option("header", True).csv(path))
    from pyspark.sql import functions as F

    typed = []
    for field in schema.TRANSACTION_SCHEMA.fields:
        if field.name not in raw.columns:
            continue
        c = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            typed.append(F.try_to_timestamp(c).alias(field.name))
        elif isinstance(field.dataType, T.LongType):
            typed.append(c.try_cast("double").cast("long").alias(field.name))
        else:
            typed.append(c.try_cast(field.dataType.simpleString()).alias(field.name))
    return nan_to_null(raw.select(*typed))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    require_path(spark, path)
    return nan_to_null(spark.read.parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_value(value: object, path: str) -> None:
    """One small value as one JSON text row."""
    spark = SparkSession.active()
    text = json.dumps(value, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json_value(path: str):
    spark = SparkSession.active()
    return json.loads("\n".join(row[0] for row in spark.read.text(path).collect()))


class Stages:
    """Stage tables under one folder: computed once, read back when asked to resume."""

    def __init__(self, spark: SparkSession, folder: str, resume: tuple[str, ...] = ()):
        self.spark, self.folder, self.resume = spark, folder, resume

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def get(self, name: str, compute) -> DataFrame:
        if name in self.resume:
            require_path(self.spark, self.path(name))
        else:
            write_table(compute(), self.path(name))
        return self.spark.read.parquet(self.path(name))


def read_prepared(spark: SparkSession, path: str, label: str = "loyalty_class") -> DataFrame:
    """Prepared model data: Parquet (possibly with a ``split`` column) or CSV with the label."""
    require_path(spark, path)
    df = read_csv(spark, path, infer=True) if path.endswith(".csv") else spark.read.parquet(path)
    if label not in df.columns:
        raise ValueError(f"prepared data needs the label column {label}")
    return df
