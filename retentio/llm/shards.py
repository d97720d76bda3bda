"""Shards by jump consistent hashing: no ring table, and appending a shard moves only what it takes.

The key of a row is a 60-bit hash of its id, so a row's shard depends on its id and the number
of shards alone. Going from n to n+1 shards moves about 1/(n+1) of the rows, all of them into
the new shard. Assigning is a map over the rows; nothing is shuffled.

Defined results: a null id is a key like any other (all such rows share one shard); a null
text counts as no bytes with the checksum of empty text; repeated rows get the same shard and
different slots; empty tables give empty results; other columns pass through untouched (the
columns added are named by parameters).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions.columns import hash_key
from retentio.operators.ranking import running_total

SEED = 17
STEP = np.uint64(2862933555777941757)  # fixed value of the published jump hash


def stable_key(*ids: Column) -> Column:
    """60-bit key of the id columns; null is a value of its own."""
    return hash_key(*[F.coalesce(i.cast("string"), F.lit("null")) for i in ids], seed=SEED)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, all keys jumping at once."""
    state = keys.astype(np.uint64).copy()
    shard = np.zeros(len(state), dtype=np.int64)
    ahead = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = ahead[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * STEP + np.uint64(1)
        spread = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[live] = ((shard[live] + 1) * (2147483648.0 / spread)).astype(np.int64)
        live = live[ahead[live] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Column form of :func:`jump`, a vectorised function over Arrow batches."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf(T.IntegerType())
    def assign(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return assign(key)


def assign(df: DataFrame, shards: int, ids: list[str], shard: str = "shard", grown: str | None = None) -> DataFrame:
    """Add the shard of every row and, on request, its shard once one more is appended."""
    key = stable_key(*[F.col(c) for c in ids])
    out = df.withColumn(shard, shard_of(key, shards))
    return out.withColumn(grown, shard_of(key, shards + 1)) if grown else out


def manifest(df: DataFrame, shards: int, ids: list[str], text: str = "text") -> DataFrame:
    """One narrow row per input row: ids, size, text_crc32, shard, slot, grown_shard.

    Slots number the rows of a shard from 0 in key order, then by checksum and size. Equal
    rows are counted before the shuffle and spread over their slots afterwards, so a group of
    copies is one row while it is moved.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    narrow = df.select(
        *ids,
        stable_key(*[F.col(c) for c in ids]).alias("_key"),
        (F.octet_length(content) + 16).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
    )
    counted = narrow.groupBy(*ids, "_key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))
    placed = counted.withColumn("shard", shard_of(F.col("_key"), shards)).withColumn(
        "grown_shard", shard_of(F.col("_key"), shards + 1)
    )
    order = ["_key", *ids, "text_crc32", "size"]
    numbered = _slots(placed, order)
    return numbered.select(*ids, "size", "text_crc32", "shard", "slot", "grown_shard")


def _slots(placed: DataFrame, order: list[str]) -> DataFrame:
    """Slots from running sums of the counts, over range slices of each shard."""
    ranked = running_total(placed, order, {"_upto": "_n"}, ["shard"])
    span = F.sequence(F.col("_upto") - F.col("_n"), F.col("_upto") - 1)
    return ranked.withColumn("slot", F.explode(span))


def write(df: DataFrame, path: str, shards: int, ids: list[str], parts: int = 1) -> None:
    """Write whole rows as one folder per shard, each in ``parts`` files.

    A shard of any size is split by row key over its parts, so no task holds a whole shard.
    """
    key = stable_key(*[F.col(c) for c in ids])
    placed = assign(df, shards, ids, "shard").withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)))
    placed.repartition(shards * parts, "shard", "_part").drop("_part").write.partitionBy("shard").parquet(path)
