"""Importance resampling of documents towards the hashed n-gram distribution of a target set.

Method (batch concatenation): the texts of one Arrow batch are joined into one buffer with a
separator sentinel (a byte that is never part of a word), one regular-expression pass finds
every word of the batch, ``searchsorted`` of the word starts against the texts' offsets gives
each word its document, n-grams whose first and last word lie in different documents are
masked, and ``bincount`` counts the features' hash buckets (corpus pass) or sums the
buckets' gains per document (weighting pass). Spark sums the bucket counts of all batches
(partial aggregation, so a frequent bucket is combined before the shuffle); the gain table
has exactly ``buckets`` entries and is the only thing sent to the workers. The draw is a
Gumbel-top-k: score = weight + Gumbel noise from a hash of the id, the highest scores are
taken, ranks come from a distributed range sort.

Words: A-Z lower-cased (nothing else), then runs of bytes outside 0x00-0x2F, 0x3A-0x60,
0x7B-0x7F (so digits, a-z and every non-ASCII character). A feature is a run of ``n_min`` to
``n_max`` consecutive words of one text joined by one space; its bucket is the unsigned
crc32 of its UTF-8 bytes modulo ``buckets``.

Defined results: a null or empty text has no words and no features, weight 0 (it is drawn
only if it has at least ``min_words`` words, so never); a null id hashes as empty text after
the prefix and orders after all ids; repeated rows are separate documents with equal
scores, ranked one after the other; very long texts are read whole, a batch at a time; an
empty table gives no rows; an empty target set counts T = 0 and t = 0 everywhere; extra
columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.llm.arrays import bounded_batches, slices
from retentio.operators.ranking import with_row_index
from retentio.session import materialize

# fixed values of the contract
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SENTINEL = b"\x00"  # never inside a word
BUCKETS = 10_000
SEED_PREFIX = "2024:"
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def features(texts: list[bytes], n_min: int = 1, n_max: int = 1, buckets: int = BUCKETS):
    """(document of each feature, bucket of each feature, words per text) of a batch."""
    buffer = SENTINEL.join(texts).translate(_UPPER)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    found = [(m.start(), m.group()) for m in WORD.finditer(buffer)]
    starts = np.fromiter((s for s, _ in found), dtype=np.int64, count=len(found))
    words = [w for _, w in found]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    n_words = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    docs, keys = [], []
    cache: dict[bytes, int] = {}
    for n in range(n_min, n_max + 1):
        if len(words) < n:
            break
        inside = np.flatnonzero(doc[: len(words) - n + 1] == doc[n - 1 :])  # cross-text n-grams masked
        grams = words if n == 1 else [b" ".join(words[i : i + n]) for i in inside.tolist()]
        docs.append(doc[inside])
        keys.append(_buckets(grams, buckets, cache))
    if docs:
        return np.concatenate(docs), np.concatenate(keys), n_words
    return np.empty(0, np.int64), np.empty(0, np.int64), n_words


def _buckets(grams: list[bytes], buckets: int, cache: dict[bytes, int]) -> np.ndarray:
    """crc32 bucket of every feature, each distinct feature hashed once."""
    out = np.empty(len(grams), dtype=np.int64)
    get = cache.get
    for j, g in enumerate(grams):
        b = get(g)
        if b is None:
            b = cache[g] = zlib.crc32(g) % buckets
        out[j] = b
    return out


def bucket_counts(texts: DataFrame, text: str, n_min: int, n_max: int, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, count) over all texts; the counts of every batch are combined in Spark."""

    def count(batches):
        for _, raw in slices(batches, "_text"):
            _, keys, _ = features(raw, n_min, n_max, buckets)
            totals = np.bincount(keys, minlength=buckets)
            nonzero = np.flatnonzero(totals)
            yield pd.DataFrame({"bucket": nonzero.astype(np.int64), "count": totals[nonzero].astype(np.int64)})

    counted = bounded_batches(texts.select(F.col(text).alias("_text"))).mapInArrow(
        _as_arrow(count), "bucket long, count long"
    )
    return counted.groupBy("bucket").agg(F.sum("count").alias("count"))


def _as_arrow(fn):
    def run(batches):
        for frame in fn(batches):
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return run


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) in doubles."""
    spark = docs.sparkSession
    every = spark.range(buckets).select(F.col("id").alias("bucket"))
    s = docs.withColumnRenamed("count", "s")
    t = target.withColumnRenamed("count", "t")
    joined = every.join(F.broadcast(s), "bucket", "left").join(F.broadcast(t), "bucket", "left").fillna(0, ["s", "t"])
    totals = joined.agg(F.sum("s"), F.sum("t")).first()
    big_s, big_t, b = float(totals[0] or 0), float(totals[1] or 0), float(buckets)
    ratio = ((F.col("t") + 1.0) * F.lit(big_s + b)) / ((F.col("s") + 1.0) * F.lit(big_t + b))
    return joined.select("bucket", F.floor(1000.0 * F.log(ratio)).cast("long").alias("gain"))


def weighted(texts: DataFrame, id_col: str, text: str, gain: np.ndarray, n_min: int, n_max: int) -> DataFrame:
    """(doc id, n_words, n_features, weight) of every row: the sum of its features' gains."""
    buckets = len(gain)

    def weigh(batches):
        for batch, raw in slices(batches, "_text"):
            doc, keys, n_words = features(raw, n_min, n_max, buckets)
            n = len(raw)
            yield pd.DataFrame(
                {
                    "_id": batch.column("_id").to_pandas(),
                    "n_words": n_words,
                    "n_features": np.bincount(doc, minlength=n).astype(np.int64),
                    "weight": np.bincount(doc, weights=gain[keys].astype(np.float64), minlength=n).astype(np.int64),
                }
            )

    rows = bounded_batches(texts.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text")))
    return rows.mapInArrow(_as_arrow(weigh), "_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2**32))), h the first 8 hex digits of sha256('2024:<id>')."""
    key = F.concat(F.lit(SEED_PREFIX), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    min_words: int = 20,
    n_min: int = 1,
    n_max: int = 1,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Every document with doc_id, n_features, weight, score and rank (1.. if drawn, else null).

    Of the N documents with at least ``min_words`` words, floor(percent * N / 100) highest
    scores are drawn; ties go to the smaller id.
    """
    corpus = bucket_counts(docs, text, n_min, n_max, buckets)
    aimed = bucket_counts(target, text, n_min, n_max, buckets)
    table = gains(corpus, aimed, buckets).toPandas()  # exactly ``buckets`` rows
    gain = np.zeros(buckets, dtype=np.int64)
    gain[table["bucket"].to_numpy()] = table["gain"].to_numpy()
    rows = materialize(weighted(docs, id_col, text, gain, n_min, n_max), "weights")
    scored = rows.withColumn("score", (F.col("weight").cast("double") + gumbel(F.col("_id"))).cast("long"))
    eligible = scored.where(F.col("n_words") >= min_words)
    n = eligible.count()
    drawn = percent * n // 100
    ranked = with_row_index(eligible, [F.col("score").desc(), F.col("_id").asc_nulls_last()], "_index")
    ranks = ranked.select(
        "_id", "n_words", "n_features", "weight", "score",
        F.when(F.col("_index") < drawn, F.col("_index") + 1).cast("long").alias("rank"),
    )
    rest = scored.where(~(F.col("n_words") >= min_words)).withColumn("rank", F.lit(None).cast("long"))
    return ranks.unionByName(rest).withColumnRenamed("_id", id_col)
