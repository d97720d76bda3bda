"""Threshold-scaled sketches of documents: every shingle hash below a fixed fraction is kept.

A sketch holds all distinct 64-bit hashes of a text's shingles that lie below a bound. The bound
is the same fraction of the hash range for every long text, so sketches of very unequal texts
are comparable and unions of texts have the union of their sketches. A text with few hashes
below the fraction keeps its ``LEAST`` smallest and notes the wider bound up to which it is
complete. Two sketches are compared below the smaller of their bounds.

Written as text, a sketch is base64 of little-endian numbers: the bound, then the hashes.

Defined results: null and empty texts have an empty, complete sketch, like only each other;
texts of fewer words than a shingle are one shingle; equal texts have equal sketches; repeated
rows are rows of their own; empty tables give empty results; other columns pass through
:func:`sketched`, whose added column must not exist yet.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.llm.arrays import Words, blocks, bounded_batches, slices, window_hashes

SHINGLE = 5
FRACTION = 1 / 8
LEAST = 16
WHOLE = np.iinfo(np.uint64).max  # bound of a complete sketch

Sketch = tuple[int, np.ndarray]


def sketches_of(texts: list[bytes], shingle: int = SHINGLE, fraction: float = FRACTION) -> list[Sketch]:
    """(bound, sorted distinct hashes not above it) of each text."""
    limit = int(fraction * 2**64) - 1
    out = []
    for a, b in blocks(texts):
        words = Words(texts[a:b])
        hashes = words.hashes()
        at, doc = words.windows(shingle)
        found = window_hashes(hashes, shingle)[at] if len(at) else np.zeros(0, dtype=np.uint64)
        low = found <= np.uint64(limit)
        per_text = np.bincount(doc[low], minlength=b - a) if len(at) else np.zeros(b - a, dtype=np.int64)
        first_low = np.concatenate([[0], np.cumsum(per_text)])
        first_all = np.searchsorted(doc, np.arange(b - a + 1))
        below = found[low]
        for i in range(b - a):
            n = int(words.counts[i])
            if 0 < n < shingle:
                short = hashes[words.first[i] : words.first[i + 1]]
                out.append((int(WHOLE), window_hashes(short, n, salt=n)))
                continue
            kept = np.unique(below[first_low[i] : first_low[i + 1]])
            if len(kept) >= LEAST:
                out.append((limit, kept))
                continue
            every = np.unique(found[first_all[i] : first_all[i + 1]])
            if len(every) <= LEAST:
                out.append((int(WHOLE), every))
            else:
                out.append((max(limit, int(every[LEAST - 1])), every[: max(LEAST, len(kept))]))
    return out


def shared(a: Sketch, b: Sketch) -> tuple[int, int, int]:
    """Hashes of a, of b, and of both, below the bound up to which both are complete."""
    bound = np.uint64(min(a[0], b[0]))
    left, right = (s[1][: np.searchsorted(s[1], bound, side="right")] for s in (a, b))
    return len(left), len(right), len(np.intersect1d(left, right, assume_unique=True))


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated share of shingles in both among those in either; two empty texts are alike."""
    n, m, both = shared(a, b)
    if n + m == 0:
        return float(a[0] == b[0] and np.array_equal(a[1], b[1]))
    return both / (n + m - both)


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b has."""
    n, _, both = shared(a, b)
    return both / n if n else float(not len(a[1]))


def merged(a: Sketch, b: Sketch) -> Sketch:
    """Sketch of two texts taken together."""
    bound = min(a[0], b[0])
    union = np.union1d(a[1], b[1])
    return bound, union[: np.searchsorted(union, np.uint64(bound), side="right")]


def written(sketch: Sketch) -> str:
    return base64.b64encode(np.concatenate([[np.uint64(sketch[0])], sketch[1]]).astype("<u8").tobytes()).decode()


def read(text: str) -> Sketch:
    numbers = np.frombuffer(base64.b64decode(text), dtype="<u8")
    return int(numbers[0]), numbers[1:]


def sketched(docs: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Add the written sketch of every whole text; a map over Arrow batches."""
    if out in docs.columns:
        raise ValueError(f"the table already has a column {out}")
    schema = T.StructType([*docs.schema, T.StructField(out, T.StringType())])
    names = schema.fieldNames()

    def run(batches):
        for batch, texts in slices(batches, text):
            values = pa.array([written(s) for s in sketches_of(texts, shingle, fraction)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=names)

    return bounded_batches(docs).mapInArrow(run, schema)


def _bounds(docs: DataFrame, doc_id: str) -> np.ndarray:
    """Ids that cut the table into one slice per shuffle partition, about equally."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(doc_id).approxQuantile(doc_id, [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    return np.unique(np.array(cuts, dtype=np.float64)).astype(np.int64)


def _slice_numbers(ids: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """0 for null ids, else one more than the number of bounds at or below the id."""
    numbers = np.searchsorted(bounds, np.asarray(ids.fill_null(0)), side="right") + 1
    return np.where(np.asarray(ids.is_null()), 0, numbers)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, tail, doc_id, tie, text): rows dealt so that each row's successor is in its part.

    The order is descending id (nulls last), ties by text hash. Texts are shuffled once, as
    compressed bytes: the first row of every slice of ids goes to the slice before it as well,
    as a ``tail``, and the very first row follows the very last.
    """
    narrow = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"),
        F.col(text).cast("string").alias("text"),
    )
    bounds = _bounds(narrow, "doc_id")

    def first_of_slices(batches):
        best: dict[int, tuple] = {}
        for batch in batches:
            ids, ties = batch.column("doc_id"), np.asarray(batch.column("tie"))
            part = _slice_numbers(ids, bounds)
            number = np.asarray(ids.fill_null(0))
            order = np.lexsort((ties, -number, part))
            lead = order[np.unique(part[order], return_index=True)[1]]
            for i in lead.tolist():
                key = (-int(number[i]), int(ties[i]))
                p = int(part[i])
                if p not in best or key < best[p]:
                    best[p] = key
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([*best], pa.int32()),
                "number": pa.array([k[0] for k in best.values()], pa.int64()),
                "tie": pa.array([k[1] for k in best.values()], pa.int64()),
            }
        )

    found = narrow.select("doc_id", "tie").mapInArrow(first_of_slices, "part int, number long, tie long")
    leads = {r.part: (-r.l.number, r.l.tie) for r in found.groupBy("part").agg(F.min(F.struct("number", "tie")).alias("l")).collect()}
    filled = sorted(leads)
    # a slice's first row follows the last row of the next higher slice; the highest follows the lowest
    follows = {p: filled[(i + 1) % len(filled)] for i, p in enumerate(filled)}

    def deal(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            ids, ties = batch.column("doc_id"), np.asarray(batch.column("tie"))
            part = _slice_numbers(ids, bounds)
            number = np.asarray(ids.fill_null(0))
            packed = pa.array([squeeze(v or b"") for v in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            columns = [pa.array(part.astype(np.int32)), pa.array(np.zeros(len(part), dtype=bool)), ids, pa.array(ties), packed]
            rows = pa.RecordBatch.from_arrays(columns, names=["part", "tail", "doc_id", "tie", "text"])
            yield rows
            heads = [i for i, p in enumerate(part.tolist()) if leads[p] == (number[i], ties[i])]
            if heads:
                tails = rows.take(pa.array(heads))
                to = pa.array([follows[p] for p in part[heads].tolist()], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [to, pa.array([True] * len(heads)), *tails.columns[2:]], names=rows.schema.names
                )

    dealt = bounded_batches(narrow).mapInArrow(deal, "part int, tail boolean, doc_id long, tie long, text binary")
    n = max(len(filled), 1)
    return dealt.repartition(n, "part").sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), "tie")


def edited(text: str, following: str) -> str:
    """The second half of the code points (rounded down) replaced by as many of the next text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def edit_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Sketch of every text and of its edited text, and how alike they and the next document's are."""
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, contained_in_edited double"
    )

    def run(batches):
        spread = zstandard.ZstdDecompressor().decompress
        held = None  # the last row, whose successor may be in the next batch
        for batch in batches:
            part, tail, ids = (batch.column(c).to_pylist() for c in ("part", "tail", "doc_id"))
            raw = [spread(v) for v in batch.column("text").to_pylist()]
            for a, b in blocks(raw):
                made = sketches_of(raw[a:b], shingle, fraction)
                rows = [*([held] if held else []), *zip(part[a:b], tail[a:b], ids[a:b], raw[a:b], made)]
                held = rows[-1]
                pairs = [(x, y) for x, y in zip(rows, rows[1:]) if x[0] == y[0] and not x[1]]
                own = [x[3].decode() for x, _ in pairs]
                changed = [edited(t, y[3].decode()).encode() for t, (_, y) in zip(own, pairs)]
                after = sketches_of(changed, shingle, fraction)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([x[2] for x, _ in pairs], pa.int64()),
                        "n_chars": pa.array([len(t) for t in own], pa.int64()),
                        "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
                        "fingerprint": pa.array([written(x[4]) for x, _ in pairs], pa.string()),
                        "edited_fingerprint": pa.array([written(s) for s in after], pa.string()),
                        "near_edited": pa.array([likeness(x[4], s) for (x, _), s in zip(pairs, after)], pa.float64()),
                        "near_next": pa.array([likeness(x[4], y[4]) for x, y in pairs], pa.float64()),
                        "contained_in_edited": pa.array(
                            [containment(x[4], s) for (x, _), s in zip(pairs, after)], pa.float64()
                        ),
                    }
                )

    return bounded_batches(with_next(docs, doc_id, text)).mapInArrow(run, schema)
