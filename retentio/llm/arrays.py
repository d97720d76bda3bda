"""Vectorised helpers for Arrow batches of texts: bounded pieces, word spans, rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 1_000_000  # bytes of text worked on at a time
BATCH_ROWS = 500  # rows of whole texts that cross to a worker at once

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
SECOND = 0xC2B2AE3D27D4EB4F


def bounded_batches(df: DataFrame) -> DataFrame:
    """Let whole texts cross to workers in small Arrow batches; memory then follows the longest texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list[bytes], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts hold about ``size`` bytes; a longer text stands alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > size:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches cut so that each holds about ``size`` bytes of text."""
    for batch in batches:
        texts = texts_of(batch.column(text))
        for a, b in blocks(texts, size):
            yield batch.slice(a, b - a), texts[a:b]


def mixed(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    filled = 1
    with np.errstate(over="ignore"):
        while filled < n:
            step = min(filled, n - filled)
            out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
            filled += step
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """64-bit hash of every byte span, from running polynomial sums; ``base`` is odd."""
    n = len(data)
    held = _TABLES.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, BLOCK + BLOCK // 2)
        held = powers(base, size), powers(pow(base, -1, 1 << 64), size)
        if size <= 4 * BLOCK:  # tables for one long text are not kept
            _TABLES[base] = held
    power, inverse = held
    running = np.empty(n + 1, dtype=np.uint64)
    running[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=running[1:])
        sums = (running[ends] - running[starts]) * inverse[np.minimum(starts, max(n - 1, 0))]
        return mixed(sums + (ends - starts).astype(np.uint64))


class Words:
    """Words of several texts: spans in one buffer, first word of each text, hashes."""

    def __init__(self, texts: list[bytes]):
        # texts are parted by a line break, so no word crosses from one to the next
        self.buffer = b"\n".join(texts) + b"\n"
        self.bytes = np.frombuffer(self.buffer, dtype=np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        white = _WHITE[self.bytes]
        before = np.concatenate([[True], white[:-1]])
        self.starts = np.flatnonzero(before & ~white)
        self.ends = np.flatnonzero(white & ~before)
        self.first = np.searchsorted(self.starts, self.offsets)  # one more than texts
        self.counts = np.diff(self.first)

    def hashes(self, lower: bool = False, base: int = BASE) -> np.ndarray:
        """64-bit hash of every word, from running polynomial sums over the bytes."""
        data = self.bytes
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data)
        return span_hashes(data, self.starts, self.ends, base)

    def documents(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, text) of every run of ``size`` words inside one text."""
        doc = self.documents()
        n = len(doc)
        if n < size:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        at = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :])
        return at, doc[at]


def window_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` word hashes (over all words, whatever their text)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    weights = powers(BASE + 2 * salt, size)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out += words[i : i + n] * weights[i]
    return mixed(out + np.uint64(salt))
