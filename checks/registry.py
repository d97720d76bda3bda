"""Name -> Spark query and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.sql import with_ctes

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, needs: list[str] | None = None, sql: str | None = None):
    """Register a query; ``sql`` selects from the named shared CTEs."""

    def wrap(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_ctes(needs or [], sql)
        return f

    return wrap


SINGLE = -99  # compare at single precision: means of cents sit on decimal ties too often


def single(c: str) -> str:
    return f"CAST(CAST({c} AS REAL) AS DOUBLE)"


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded so that summation order cannot show."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            if special.get(f.name) == SINGLE:
                out.append(c.cast("float").cast("double").alias(f.name))
            else:
                out.append(F.round(c, special.get(f.name, digits)).alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            out.append(c.alias(f.name))
    return df.select(*out)


def ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
