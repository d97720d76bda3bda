"""Repeated token spans found on a compacted De Bruijn graph, and their removal.

The k-mers of a corpus (runs of ``window`` words of one document) are the edges of its De Bruijn
graph. An edge is repeated if it starts at two coordinates (document, word). Shuffling every edge
would move the corpus many times over, so paths are compacted first, where they are cut:

* consecutive edges of a document around the same minimiser (the place of the smallest hash of
  ``SEED_WORDS`` words inside the edge) form one path. Equal edges have equal minimisers, so repeated edges always lie
  in paths that share a minimiser, and a path whose minimiser is seen once is done with;
* a minimiser whose paths are all equal does not branch: two or more such paths are repeated as
  a whole, however many copies there are;
* at a branching minimiser, equal paths are counted, and only paths seen once (next to one
  witness of each repeated path) are opened to single edges, which meet in a join by two
  independent 64-bit hashes.

Repeated paths and edges go back to their source coordinates; there they are joined to maximal
spans and checked against the words they came from (a span must lie within its document).

Defined results: null and empty texts, and texts shorter than a window, have nothing removed;
repeated rows repeat all their windows and lose them; null or repeated ids are told apart by a
checksum of their text; empty tables give empty results; other columns pass through, and working
columns have names that are refused if the table has them already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.llm.arrays import BASE, SECOND, Words, blocks, bounded_batches, mixed, powers, window_hashes
from retentio.session import materialize

SEED_WORDS = 8
KEY = ["_doc", "_copy"]
_PATHS = "_doc long, _copy long, start int, edges int, minimiser long, content long"
_EDGES = "_doc long, _copy long, start int, first long, second long"


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add a row key: the id where ids are unique, else id and text checksum."""
    clash = {"_doc", "_copy", "_spans", "_packed"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are reserved")
    number = isinstance(docs.schema[doc_id].dataType, T.IntegralType)
    value = F.col(doc_id).cast("long") if number else F.xxhash64(doc_id)
    ids = docs.groupBy(F.col(doc_id).alias("i")).count()
    plain = number and ids.filter("count > 1 OR i IS NULL").isEmpty()
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    copy = F.lit(0).cast("long") if plain else crc + F.col(doc_id).isNull().cast("long") * F.lit(1 << 32)
    return docs.withColumn("_doc", F.coalesce(value, F.lit(0).cast("long"))).withColumn("_copy", copy)


def _packed(rows: DataFrame, text: str) -> DataFrame:
    """Texts as compressed bytes, which is how they cross a shuffle."""
    names = rows.columns
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == text else f for f in rows.schema])

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            columns = list(batch.columns)
            i = names.index(text)
            values = columns[i].cast(pa.binary()).to_pylist()
            columns[i] = pa.array([None if v is None else squeeze(v) for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return bounded_batches(rows).mapInArrow(run, schema)


def _unpacked(column) -> list[bytes]:
    spread = zstandard.ZstdDecompressor().decompress
    return [b"" if v is None else spread(v) for v in column.to_pylist()]


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values, from running minima of blocks."""
    n = len(values) - width + 1
    pad = np.full(-len(values) % width, np.iinfo(np.uint64).max, dtype=np.uint64)
    rows = np.concatenate([values, pad]).reshape(-1, width)
    onward = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], onward[width - 1 : width - 1 + n])


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _paths_of(texts: list[bytes], window: int):
    """Compacted paths: text, first word in its text, number of edges, minimiser, content."""
    words = Words(texts)
    at, doc = words.windows(window)
    if not len(at):
        return None
    hashes = words.hashes()
    edges = window_hashes(hashes, window)[at]
    seed = min(SEED_WORDS, window)
    seeds = window_hashes(hashes, seed)
    least = _smallest(seeds, window - seed + 1)[at]
    # a path ends where its (leftmost) minimiser drops out of the edge or is undercut, so no
    # edge can repeat inside a path: equal edges have it at the same distance
    new = np.ones(len(at), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (seeds[at[:-1]] == least[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    # content: a polynomial over all edges of the path, the same wherever it stands
    running = np.zeros(len(at) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(edges * powers(BASE, len(at)), out=running[1:])
        content = (running[begin + size] - running[begin]) * powers(pow(BASE, -1, 1 << 64), len(at))[begin]
    content = mixed(content + size.astype(np.uint64))
    return doc[begin], at[begin] - words.first[doc[begin]], size, least[begin], content


def paths(rows: DataFrame, window: int, text: str = "text") -> DataFrame:
    """All compacted paths with their source coordinates; a map over Arrow batches."""
    narrow = rows.select(*KEY, F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            texts = [v or b"" for v in batch.column("text").cast(pa.binary()).to_pylist()]
            doc, copy = (np.asarray(batch.column(k)) for k in KEY)
            for a, b in blocks(texts):
                found = _paths_of(texts[a:b], window)
                if found is not None:
                    which, start, size, least, content = found
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc[a + which]),
                            pa.array(copy[a + which]),
                            pa.array(start.astype(np.int32)),
                            pa.array(size.astype(np.int32)),
                            _signed(least),
                            _signed(content),
                        ],
                        names=["_doc", "_copy", "start", "edges", "minimiser", "content"],
                    )

    return bounded_batches(narrow).mapInArrow(run, _PATHS)


def _edges_of(rows: DataFrame, window: int) -> DataFrame:
    """Single edges of the paths listed in ``_spans`` of every row."""

    def run(batches):
        for batch in batches:
            texts = _unpacked(batch.column("text"))
            doc, copy = (np.asarray(batch.column(k)) for k in KEY)
            spans = batch.column("_spans").to_pylist()
            for a, b in blocks(texts):
                words = Words(texts[a:b])
                hashes = (words.hashes(), words.hashes(base=SECOND))
                start = np.array([s["start"] + words.first[i] for i in range(b - a) for s in spans[a + i]], dtype=np.int64)
                size = np.array([s["edges"] for i in range(b - a) for s in spans[a + i]], dtype=np.int64)
                which = np.repeat(np.arange(a, b), [len(s) for s in spans[a:b]])
                if not len(start):
                    continue
                total = np.cumsum(size)
                at = np.repeat(start - (total - size), size) + np.arange(total[-1])
                which = np.repeat(which, size)
                first = window_hashes(hashes[0], window)[at]
                second = window_hashes(hashes[1], window, salt=1)[at]
                place = (at - words.first[which - a]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[which]), pa.array(copy[which]), pa.array(place), _signed(first), _signed(second)],
                    names=["_doc", "_copy", "start", "first", "second"],
                )

    return bounded_batches(rows.select(*KEY, "text", "_spans")).mapInArrow(run, _EDGES)


def repeated_paths(rows: DataFrame, window: int, text: str = "text") -> DataFrame:
    """(key, start, edges) of the repeated stretches: paths repeated as a whole, and single edges."""
    everything = paths(rows, window, text)
    per_minimiser = everything.groupBy("minimiser").agg(
        F.count(F.lit(1)).alias("n"), F.min("content").alias("low"), F.max("content").alias("high")
    )
    # written, so that the join deals out its own sides and can split a very frequent minimiser
    seen_again = materialize(
        per_minimiser.filter("n > 1").select("minimiser", (F.col("low") != F.col("high")).alias("branches")), "minimisers"
    )
    candidates = materialize(everything.join(seen_again, "minimiser"), "paths")
    straight = candidates.filter("NOT branches").select(*KEY, "start", "edges")
    branching = candidates.filter("branches")
    coordinate = F.struct(*KEY, "start", "edges")
    counted = materialize(
        branching.groupBy("minimiser", "content").agg(F.count(F.lit(1)).alias("n"), F.min(coordinate).alias("at")), "branches"
    )
    whole = branching.join(counted.filter("n > 1").select("minimiser", "content"), ["minimiser", "content"])
    # one coordinate of every distinct path: those seen once, and a witness of each repeated one
    opened = counted.select("at.*").groupBy(*KEY).agg(F.collect_list(F.struct("start", "edges")).alias("_spans"))
    texts = _packed(rows.select(*KEY, F.col(text).cast("string").alias("text")), "text")
    edges = materialize(_edges_of(texts.join(opened, KEY), window), "edges")
    met = materialize(edges.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "met")
    single = edges.join(met, ["first", "second"]).select(*KEY, "start", F.lit(1).alias("edges"))
    return straight.union(whole.select(*KEY, "start", "edges")).union(single)


def marked(docs: DataFrame, window: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` with compressed text, the key and ``_spans``, the repeated stretches (or null)."""
    rows = keyed(docs, doc_id, text)
    found = repeated_paths(rows, window, text)
    spans = found.groupBy(*KEY).agg(F.collect_list(F.struct("start", "edges")).alias("_spans"))
    return _packed(rows.withColumn(text, F.col(text).cast("string")), text).join(spans, KEY, "left")


def _covered(n: int, spans: list[dict], window: int) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    change = np.zeros(n + 1, dtype=np.int64)
    for s in spans:
        stop = s["start"] + s["edges"] - 1 + window
        if stop > n:
            raise ValueError("a repeated span reaches past its document")
        change[s["start"]] += 1
        change[stop] -= 1
    return np.cumsum(change[:n]) > 0


def without_repeats(
    docs: DataFrame,
    window: int,
    doc_id: str = "doc_id",
    text: str = "text",
    n_words: str = "n_words",
    n_removed: str = "n_removed",
    removed: str = "removed_spans",
) -> DataFrame:
    """Rows of ``docs`` whose text has lost every word of a repeated window.

    Texts that lose nothing keep every character. In the others, each removed word goes with the
    white space after it. Adds the number of words, of removed words, and the removed spans as
    [first word, end) pairs.
    """
    rows = marked(docs, window, doc_id, text)
    spans = T.ArrayType(T.ArrayType(T.IntegerType(), False), False)
    fields = [T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema]
    schema = T.StructType(
        [*fields, T.StructField(n_words, T.LongType()), T.StructField(n_removed, T.LongType()), T.StructField(removed, spans)]
    )
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = _unpacked(batch.column(text))
            nulls = batch.column(text).is_null().to_pylist()
            found = batch.column("_spans").to_pylist()
            kept, counts, losses, lost = [], [], [], []
            for a, b in blocks(texts):
                words = Words(texts[a:b])
                for i in range(a, b):
                    first, stop = words.first[i - a], words.first[i - a + 1]
                    n = int(stop - first)
                    gone = _covered(n, found[i] or [], window)
                    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                    counts.append(n)
                    losses.append(int(gone.sum()))
                    lost.append(edges.tolist())
                    if nulls[i]:
                        kept.append(None)
                    elif not len(edges):
                        kept.append(texts[i])
                    else:
                        base = words.offsets[i - a]
                        begins = np.append(words.starts[first:stop] - base, len(texts[i]))
                        parts, at = [], 0
                        for x, y in edges:
                            parts.append(texts[i][at : begins[x]])
                            at = begins[y]
                        kept.append(b"".join([*parts, texts[i][at:]]))
            columns = [
                pa.array(kept, pa.binary()).cast(pa.string()) if name == text else batch.column(name) for name in names
            ]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int64()), pa.array(losses, pa.int64()), pa.array(lost, pa.list_(pa.list_(pa.int32())))],
                names=[*names, n_words, n_removed, removed],
            )

    return bounded_batches(rows).mapInArrow(run, schema)


def words_digest(text: str) -> Column:
    """SHA-256 of the words of a text joined by one space."""
    bare = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.sha2(F.array_join(F.split(bare, r"[ \t-\r]+"), " "), 256)
