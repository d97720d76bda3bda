"""SimHash near-duplicates found by meeting in the middle.

Two fingerprints that differ in at most d bits have a value in common within floor(d/2) bits
of one and ceil(d/2) bits of the other. So every distinct fingerprint emits all variants within
those radii, the shuffle brings equal variants together, and pairs that meet are verified by
their bit distance. No bit pattern is assumed rare: a variant can only come from the ball
around it, so at most 65 distinct fingerprints meet in one variant for d = 2, however large
the groups of copies are (copies are one fingerprint).

Defined results: null and empty texts (and texts of white space) have the fingerprint zero and
are linked like any other; texts shorter than a shingle are one shingle; repeated rows and
ties share a fingerprint and a component; empty tables give empty results; other columns pass
through :func:`deduplicated` untouched. The component of a row is named by the smallest id in
it; null ids belong to components but never name one unless all ids are null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.llm.arrays import bounded_batches, slices
from retentio.llm.graphs import components
from retentio.session import materialize

_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
SEED = 42


def _simhash(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints_of(texts: list[bytes], shingle: int) -> np.ndarray:
    """Signed 64-bit fingerprint of each text."""
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), dtype=np.uint64)
    for i, text in enumerate(texts):
        words = text.translate(_LOWER).split()  # bytes split at ASCII white space only
        if not words:
            continue
        joined = b" ".join(words)
        n = len(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
        if n <= shingle:
            hashes = np.array([digest(joined, SEED)], dtype=np.uint64)
        else:
            stops = ends[shingle - 1 :].tolist()
            begins = [0, *(ends[: n - shingle] + 1).tolist()]
            hashes = np.fromiter(
                (digest(joined[a:b], SEED) for a, b in zip(begins, stops)), dtype=np.uint64, count=n - shingle + 1
            )
        out[i] = _simhash(hashes)
    return out.view(np.int64)


def fingerprints(
    docs: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text", hashed: bool = False
) -> DataFrame:
    """(doc_id, fingerprint) of every row; a map over Arrow batches, nothing is shuffled.

    With ``hashed``, ``text_hash`` (64 bits) comes with them and names the text of a row.
    """
    kept = ["doc_id", *(["text_hash"] if hashed else [])]
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    if hashed:
        narrow = narrow.withColumn("text_hash", F.xxhash64("text"))
    schema = T.StructType([*[narrow.schema[c] for c in kept], T.StructField("fingerprint", T.LongType())])

    def run(batches):
        for batch, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(fingerprints_of(texts, shingle))], names=[*kept, "fingerprint"]
            )

    return bounded_batches(narrow).mapInArrow(run, schema)


def _masks(radius: int) -> list[int]:
    """All 64-bit masks of at most ``radius`` set bits, as signed numbers."""
    out = []
    for r in range(radius + 1):
        for bits in combinations(range(64), r):
            mask = sum(1 << b for b in bits)
            out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _ball(prints: DataFrame, radius: int, name: str) -> DataFrame:
    variants = F.transform(F.array(*[F.lit(m).cast("long") for m in _masks(radius)]), lambda m: F.col("f").bitwiseXOR(m))
    return prints.withColumn("variant", F.explode(variants)).select(F.col("f").alias(name), "variant")


def links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``f`` that connect all within ``max_bits`` bits.

    For an even distance, all fingerprints that meet in a variant are within ``max_bits`` of
    each other, so a chain through them loses no connection and is as long as the group. For
    an odd distance the two sides have different radii and meet in a join on the variant.
    """
    if max_bits < 0:
        raise ValueError("the distance is not negative")
    near = max_bits // 2
    if max_bits % 2 == 0:
        order = Window.partitionBy("variant").orderBy("f")
        met = _ball(prints, near, "f").withColumn("before", F.lag("f").over(order)).filter("before IS NOT NULL")
        pairs = met.select(F.col("before").alias("a"), F.col("f").alias("b"))
    else:
        met = _ball(prints, near, "a").join(_ball(prints, near + 1, "b"), "variant")
        pairs = met.filter("a < b").select("a", "b")
    verified = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return pairs.distinct().filter(verified)


def near_duplicates(docs: DataFrame, shingle: int, max_bits: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    printed = materialize(fingerprints(docs, shingle, doc_id, text), "simhash")
    return _in_components(printed, max_bits).select("doc_id", "fingerprint", "component_id")


def _in_components(printed: DataFrame, max_bits: int) -> DataFrame:
    """Adds ``root`` (a fingerprint, which names the component) and ``component_id`` (its least id)."""
    distinct = materialize(printed.groupBy(F.col("fingerprint").alias("f")).agg(F.min("doc_id").alias("least")), "prints")
    roots = components(links(distinct, max_bits))
    rooted = distinct.join(roots, F.col("f") == F.col("node"), "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return printed.join(named.select(F.col("f").alias("fingerprint"), "root", "component_id"), "fingerprint")


def hexadecimal(fingerprint: Column) -> Column:
    """16 lowercase hexadecimal digits of a signed 64-bit number."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def deduplicated(docs: DataFrame, shingle: int, max_bits: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One whole row of each component: the row with the smallest id.

    Rows are told apart by id and text (a 64-bit hash), not by id alone: an id may repeat with
    different texts, in one component or several, or be null. Among the texts of the smallest id
    in a component the one with the least text hash stays; rows equal in id and text are one
    document, of which one row stays. Only keys of dropped rows are joined with the documents.
    """
    printed = materialize(fingerprints(docs, shingle, doc_id, text, hashed=True), "simhash")
    found = materialize(
        _in_components(printed, max_bits)
        .groupBy("doc_id", "text_hash", "root", "component_id")
        .agg(F.count(F.lit(1)).alias("copies")),
        "components",
    )
    # null ids are smallest only where a component has no others; only rows of the smallest id meet by component
    smallest = F.col("doc_id").eqNullSafe(F.col("component_id"))
    least = found.filter(smallest).groupBy("root").agg(F.min("text_hash").alias("kept"))
    first = found.filter(smallest).join(least, "root").withColumn("stays", F.col("text_hash") == F.col("kept"))
    both = first.drop("kept").unionByName(found.filter(~smallest).withColumn("stays", F.lit(False)))
    key = [F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")]
    marked = materialize(both.select(*key, "copies", "stays"), "marked")
    hashed = docs.withColumn("_text_hash", F.xxhash64(F.col(text).cast("string")))
    same = F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    kept = hashed.join(marked.filter(~F.col("stays")).select("_id", "_hash"), same, "left_anti")
    again = marked.filter(F.col("stays") & (F.col("copies") > 1)).select("_id", "_hash")
    if again.isEmpty():
        return kept.select(*docs.columns)
    several = kept.join(again, same, "left_semi").dropDuplicates([doc_id, "_text_hash"])
    return kept.join(again, same, "left_anti").unionByName(several).select(*docs.columns)
