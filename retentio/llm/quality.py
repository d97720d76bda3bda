"""A quality classifier: regularised quadratic discriminant over document statistics.

Every whole text becomes a row of transformed statistics. Each class is a normal density whose
covariance is its own, shrunk towards the pooled one and towards its diagonal. Sums and products
of the statistics are added up where the rows are (one small row per task reaches the driver); a
score is the difference of the two log-densities, from Mahalanobis distances by the Cholesky
factors kept in the model.

Defined results: null and empty texts have the statistics of an empty text and are scored like
any other; labels that are null or of ids without a document train nothing, and repeated labels
count as often as they occur; a class without training rows gets the pooled density, and
without any training rows every score is 0.5; repeated rows get equal scores; empty tables give
empty results. Other columns pass through :func:`with_scores`, whose added names must be free.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.llm.arrays import Words, blocks, bounded_batches, mixed, span_hashes, texts_of, window_hashes

NAMES = (
    "log_words",
    "log_word_length",
    "word_length_spread",
    "symbols",
    "capitals",
    "digits",
    "shouts",
    "stops",
    "lines",
    "same_lines",
    "distinct_words",
    "repeated_words",
    "stutter",
    "non_ascii",
    "longest_word",
    "brackets",
)
OWN, SPHERE = 0.7, 0.1  # weight of a class's own covariance, and of the diagonal target

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _class_of(characters: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(characters)] = True
    return table


_SYMBOLS, _DIGITS = _class_of(b"#*$%&|<>"), _class_of(b"0123456789")
_CAPITALS, _SHOUTS, _STOPS = _class_of(bytes(range(65, 91))), _class_of(b"!"), _class_of(b".,")
_BRACKETS = _class_of(b"{}[]()=;_/\\")


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document the number of distinct keys; how often each key occurs in its document."""
    with np.errstate(over="ignore"):
        own = mixed(keys + doc.astype(np.uint64) * _ODD)
    _, first, which, times = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
    return np.bincount(doc[first], minlength=n), times[which], first


def statistics_of(texts: list[bytes]) -> np.ndarray:
    """One row of transformed statistics per text."""
    words, n = Words(texts), len(texts)
    data, doc = words.bytes, words.documents()
    hashes = words.hashes()

    def per_text(mask: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(mask)])
        return running[words.offsets[1:]] - running[words.offsets[:-1]]

    count = words.counts.astype(np.float64)
    some = np.maximum(count, 1.0)
    continued = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
    size = (words.ends - words.starts) - (continued[words.ends] - continued[words.starts])
    letters = np.maximum(np.bincount(doc, weights=size, minlength=n), 1.0)
    mean = letters / some
    spread = np.sqrt(np.maximum(np.bincount(doc, weights=size.astype(float) ** 2, minlength=n) / some - mean**2, 0.0))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, size)
    distinct, times, _ = _distinct(hashes, doc, n)
    at, window_doc = words.windows(3)
    again = np.zeros(len(hashes) + 2, dtype=bool)
    if len(at):
        _, seen, _ = _distinct(window_hashes(hashes, 3)[at], window_doc, n)
        for k in range(3):
            again[at[seen > 1] + k] = True
    repeated = np.bincount(doc[again[: len(doc)]], minlength=n)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    stutter = np.bincount(doc[same], minlength=n)
    # lines that hold a word
    breaks = np.flatnonzero(data == 10)
    begin = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else np.zeros(0, dtype=np.int64)
    held = np.searchsorted(words.starts, breaks) > np.searchsorted(words.starts, begin)
    begin, stop = begin[held], breaks[held]
    line_doc = np.searchsorted(words.offsets, begin, side="right") - 1
    lines = np.bincount(line_doc, minlength=n)
    different, _, _ = _distinct(span_hashes(data, begin, stop), line_doc, n) if len(begin) else (np.zeros(n), None, None)
    # capitals: A-Z, and two-byte capitals of the Latin-1 letters
    latin = np.zeros(len(data), dtype=bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    columns = (
        np.log1p(count),
        np.log(mean),
        np.log1p(spread),
        np.sqrt(per_text(_SYMBOLS[data]) / some),
        np.sqrt(per_text(_CAPITALS[data] | latin) / letters),
        np.sqrt(per_text(_DIGITS[data]) / letters),
        np.sqrt(per_text(_SHOUTS[data]) / some),
        np.sqrt(per_text(_STOPS[data]) / some),
        np.log1p(lines) - np.log1p(count),
        np.sqrt((lines - different) / np.maximum(lines, 1)),
        (distinct / some) + 0.08 * np.log1p(count),
        np.sqrt(repeated / some),
        np.sqrt(stutter / some),
        np.sqrt(per_text(data >= 0x80) / np.maximum(np.diff(words.offsets), 1)),
        np.log1p(longest),
        np.sqrt(per_text(_BRACKETS[data]) / some),
    )
    return np.stack(columns, axis=1)


def with_statistics(docs: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    """Add the row of statistics of every whole text; the text itself goes no further."""
    kept = [c for c in docs.columns if c != text]
    if out in kept:
        raise ValueError(f"the table already has a column {out}")
    schema = T.StructType([*docs.select(*kept).schema, T.StructField(out, T.ArrayType(T.DoubleType(), False), False)])

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(text))
            rows = [statistics_of(texts[a:b]) for a, b in blocks(texts)]
            values = np.concatenate(rows) if rows else np.zeros((0, len(NAMES)))
            offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(NAMES))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))],
                names=schema.fieldNames(),
            )

    return bounded_batches(docs).mapInArrow(run, schema)


@dataclass(frozen=True)
class Moments:
    """Number, sums and products of the statistics of one class."""

    n: float
    sums: np.ndarray
    products: np.ndarray


def moments(rows: DataFrame, label: str, statistics: str = "statistics") -> dict[int, Moments]:
    """Moments of each class, added up inside the tasks and then across them."""
    d = len(NAMES)
    schema = "label int, n double, sums array<double>, products array<double>"

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            labels = np.asarray(batch.column("label"))
            values = np.asarray(batch.column("x").flatten()).reshape(-1, d)
            for c in np.unique(labels).tolist():
                x = values[labels == c]
                old = found.setdefault(c, [0.0, np.zeros(d), np.zeros((d, d))])
                old[0] += len(x)
                old[1] += x.sum(axis=0)
                old[2] += x.T @ x
        for c, (n, sums, products) in found.items():
            yield pa.RecordBatch.from_pydict(
                {"label": pa.array([c], pa.int32()), "n": [n], "sums": [sums.tolist()], "products": [products.ravel().tolist()]}
            )

    partial = rows.select(F.col(label).cast("int").alias("label"), F.col(statistics).alias("x")).mapInArrow(run, schema)
    sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(d)]
    products = [F.sum(F.col("products")[i]).alias(f"p{i}") for i in range(d * d)]
    out = {}
    for row in partial.groupBy("label").agg(F.sum("n").alias("n"), *sums, *products).collect():
        out[row.label] = Moments(
            row.n,
            np.array([row[f"s{i}"] for i in range(d)]),
            np.array([row[f"p{i}"] for i in range(d * d)]).reshape(d, d),
        )
    return out


@dataclass(frozen=True)
class Model:
    """Prior log-odds of class 1; of each class the mean, inverse Cholesky factor and log-determinant."""

    odds: float
    means: np.ndarray
    factors: np.ndarray
    determinants: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        logs = []
        for mean, factor, determinant in zip(self.means, self.factors, self.determinants):
            away = (x - mean) @ factor.T
            logs.append(-0.5 * (away**2).sum(axis=1) - 0.5 * determinant)
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1] - self.odds, -700, 700)))


def fit(found: dict[int, Moments], own: float = OWN, sphere: float = SPHERE) -> Model:
    """Densities of classes 0 and 1 from their moments."""
    d = len(NAMES)
    total = sum(m.n for m in found.values())
    if not total:
        return Model(0.0, np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2))
    scatter = {c: m.products - np.outer(m.sums, m.sums) / m.n for c, m in found.items()}
    pooled = sum(scatter.values()) / max(total - len(found), 1)
    overall = sum(m.sums for m in found.values()) / total
    means, factors, determinants = [], [], []
    for c in (0, 1):
        m = found.get(c)
        mean = m.sums / m.n if m else overall
        mine = scatter[c] / max(m.n - 1, 1) if m else pooled
        # few rows of a class say little about its covariance
        weight = own * m.n / (m.n + 10 * d) if m else 0.0
        covariance = weight * mine + (1 - weight) * pooled
        covariance = (1 - sphere) * covariance + sphere * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        lower = np.linalg.cholesky(covariance)
        means.append(mean)
        factors.append(np.linalg.inv(lower))
        determinants.append(2 * np.log(np.diag(lower)).sum())
    counts = [found[c].n if c in found else 0.0 for c in (0, 1)]
    odds = float(np.log((counts[1] + 1) / (counts[0] + 1)))
    return Model(odds, np.stack(means), np.stack(factors), np.array(determinants))


def with_scores(rows: DataFrame, model: Model, statistics: str = "statistics", out: str = "score") -> DataFrame:
    """Add the score of every row of statistics."""
    d = len(NAMES)

    @F.arrow_udf(T.DoubleType())
    def score(values: pa.Array) -> pa.Array:
        return pa.array(model.score(np.asarray(values.flatten()).reshape(-1, d)))

    if out in rows.columns:
        raise ValueError(f"the table already has a column {out}")
    return rows.withColumn(out, score(F.col(statistics)))


def train(rows: DataFrame, labels: DataFrame, held_out: Column, doc_id: str = "doc_id", label: str = "quality") -> Model:
    """Fit on the labelled rows that are not held out."""
    marks = labels.filter(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).alias("_label"))
    known = rows.filter(~held_out).join(marks, F.col(doc_id) == F.col("_id"))
    return fit(moments(known, "_label"))
