"""Cross-tokenizer alignment: groups of tokens of two vocabularies that cover the same bytes.

Tokenizer A (byte-level BPE of ``byte_bpe_50k.json``; its ids are computed by tiktoken over the
same vocabulary as ranks, which gives the ``tokenizers`` library's ids and is four times
faster) encodes ``" " + text``; tokenizer B
(sentencepiece BPE with byte fallback) encodes ``text`` and adds the space itself. Special
tokens are never produced: their strings inside a text are plain text. A token's bytes are,
for A, its vocabulary entry decoded through the byte-level alphabet, and for B its piece in
UTF-8 with U+2581 read as a space and ``<0xHH>`` read as the byte HH.

Method (divide and conquer at shared cuts): the byte offsets where tokens end form two
sorted arrays; their intersection holds the shared ends. For an interval between shared
ends, a table of shared ends up to each byte gives the one nearest its middle byte; it is cut there and
both halves are worked on the same way. An interval without a shared end inside is a leaf
group. The recursion runs one level at a time over all open intervals of a whole Arrow batch
(texts laid end to end, so every text's end is a shared end), as array operations. Links are
the overlapping (A token, B token) pairs: as both
sides tile the same bytes, they are the pieces between the merged token ends, one link per
piece. Spark counts, for every (A id, B id) pair, the documents that hold it linked
(combined before the shuffle, so a frequent pair costs one row per task), takes each A id's
highest count, and joins the counts back to the links on a salted key, so that a pair found
in most documents is spread over ``SALT`` tasks.

Defined results: a null or empty text, or one whose joined A or B token bytes differ from
``" " + text`` (normalisation by B, say), has no tokens: all counts 0 and ``groups`` ''. Each
row is a document (a repeated row counts twice in the corpus counts); a null id is kept as
null; texts are read whole however long; an empty table gives no rows; extra columns of the
input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.arrays import bounded_batches
from retentio.session import materialize

A_FILE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the same vocabulary, as tiktoken ranks
B_FILE = public_tokenizers.path("piece_bpe_32k.model")
SALT = 8  # copies of the pair counts, so that one frequent pair is joined in as many tasks
SPACE_MARK = "▁"


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level BPE alphabet (fixed values: printable bytes stand for
    themselves, the others are shifted to code points from 256 on, in byte order)."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    chars = {b: chr(b) for b in kept}
    shifted = 0
    for b in range(256):
        if b not in chars:
            chars[b] = chr(256 + shifted)
            shifted += 1
    return {c: b for b, c in chars.items()}


@lru_cache(maxsize=2)
def tokenizers(a_file: str = A_FILE, b_file: str = B_FILE):
    """(A encoder, bytes of every A id, B processor, bytes of every B id), once per worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core per task, as Spark counts
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_file)
    a.encode_special_tokens = True
    alphabet = byte_alphabet()
    a_bytes = []
    for i in range(a.get_vocab_size()):
        token = a.id_to_token(i) or ""
        if all(c in alphabet for c in token):
            a_bytes.append(bytes(alphabet[c] for c in token))
        else:  # special entries, never produced here
            a_bytes.append(token.encode())
    b = sentencepiece.SentencePieceProcessor(model_file=b_file)
    # A's ids come from tiktoken over the same vocabulary as ranks: four times faster, and the
    # same ids as the tokenizers library (all 56,282 texts of two check tables, and tests)
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(RANKS, "rb"))}
    a = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    b_bytes = []
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        if b.is_byte(i):
            b_bytes.append(bytes([int(piece[3:5], 16)]))
        elif b.is_control(i) or b.is_unknown(i):
            b_bytes.append(b"")
        else:
            b_bytes.append(piece.replace(SPACE_MARK, " ").encode())
    return a, a_bytes, b, b_bytes


def _distinct(x: np.ndarray) -> np.ndarray:
    """Values of a sorted array, each once."""
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shared_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Sorted ends present in both sorted arrays."""
    at = np.minimum(np.searchsorted(ends_b, ends_a), max(len(ends_b) - 1, 0))
    return _distinct(ends_a[ends_b[at] == ends_a]) if len(ends_b) else ends_b


def all_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Sorted ends present in either sorted array."""
    return _distinct(np.sort(np.concatenate([ends_a, ends_b]), kind="stable"))


def split_levels(cuts: np.ndarray) -> np.ndarray:
    """Divide and conquer over sorted shared ends ``cuts`` (the first is the start), one level
    at a time for all intervals: an interval with shared ends inside is cut at the one nearest
    its middle byte, looked up in a table of shared ends up to each byte; an interval without is
    a leaf. Returns the leaves as (first, last) index pairs into ``cuts``, in order."""
    if len(cuts) < 2:
        return np.empty((0, 2), dtype=np.int64)
    upto = np.cumsum(np.bincount(cuts))  # upto[x]: cuts at or before byte x
    lo, hi = np.array([0]), np.array([len(cuts) - 1])
    leaves = np.empty((len(cuts) - 1, 2), dtype=np.int64)
    while len(lo):
        leaf = hi - lo < 2
        leaves[lo[leaf], 0], leaves[lo[leaf], 1] = lo[leaf], hi[leaf]
        lo, hi = lo[~leaf], hi[~leaf]
        twice = cuts[lo] + cuts[hi]  # twice the middle byte
        right = np.clip(upto[(twice - 1) // 2], lo + 1, hi - 1)
        left = np.maximum(right - 1, lo + 1)
        at = np.where(twice - 2 * cuts[left] <= 2 * cuts[right] - twice, left, right)
        lo, hi = np.concatenate([lo, at]), np.concatenate([at, hi])
    return leaves


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Token index ranges ``(a_lo, a_hi, b_lo, b_hi)`` of the groups of one text, in order."""
    if len(ends_a) == 0 or len(ends_b) == 0:
        return []
    cuts = np.concatenate([[0], shared_ends(ends_a, ends_b)])
    leaves = split_levels(cuts)
    first, last = cuts[leaves[:, 0]], cuts[leaves[:, 1]]
    a_lo, a_hi = np.searchsorted(ends_a, first, "right"), np.searchsorted(ends_a, last, "right")
    b_lo, b_hi = np.searchsorted(ends_b, first, "right"), np.searchsorted(ends_b, last, "right")
    return [tuple(int(v) for v in row) for row in zip(a_lo, a_hi, b_lo, b_hi)]


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of every overlapping pair: one per piece between merged ends."""
    pieces = all_ends(ends_a, ends_b)
    return np.searchsorted(ends_a, pieces, "left"), np.searchsorted(ends_b, pieces, "left")


@lru_cache(maxsize=2)
def _tables(a_file: str = A_FILE, b_file: str = B_FILE):
    """Byte lengths and decimal texts (with each separator) of every id."""
    _, a_bytes, _, b_bytes = tokenizers(a_file, b_file)
    out = []
    for table, seps in ((a_bytes, (",", "|")), (b_bytes, (",", ";"))):
        lengths = np.array([len(t) for t in table], dtype=np.int64)
        texts = {sep: np.array([f"{i}{sep}" for i in range(len(table))], dtype=object) for sep in seps}
        texts[""] = np.array([str(i) for i in range(len(table))], dtype=object)
        out.append((lengths, texts))
    return out


def _spelled(table: list[bytes], ids: list[int]) -> bytes:
    """The bytes of the tokens ``ids``, joined."""
    if len(ids) < 2:
        return b"".join(table[i] for i in ids)
    return b"".join(itemgetter(*ids)(table))


def align_batch(texts: list[str | None], a_file: str = A_FILE, b_file: str = B_FILE) -> list[dict]:
    """Per text: n_a, n_b, n_groups, groups text and its distinct linked pairs with counts.

    All texts of the batch are laid end to end, so one pass of array operations serves them
    all: document boundaries are shared ends of both tokenizations."""
    a, a_bytes, b, b_bytes = tokenizers(a_file, b_file)
    (len_a, str_a), (len_b, str_b) = _tables(a_file, b_file)
    out = [{"n_a": 0, "n_b": 0, "n_groups": 0, "groups": "", "pairs": np.empty(0, np.int64), "mult": np.empty(0, np.int64)} for _ in texts]
    live = [i for i, t in enumerate(texts) if t]
    if not live:
        return out
    coded_a = a.encode_ordinary_batch([" " + texts[i] for i in live], num_threads=1)
    coded_b = b.encode([texts[i] for i in live], num_threads=1)
    kept, ids_a, ids_b = [], [], []
    for i, ea, ib in zip(live, coded_a, coded_b):
        whole = (" " + texts[i]).encode()
        if _spelled(a_bytes, ea) == whole and _spelled(b_bytes, ib) == whole:
            kept.append(i)
            ids_a.append(np.asarray(ea, dtype=np.int64))
            ids_b.append(np.asarray(ib, dtype=np.int64))
    if not kept:
        return out
    doc_a = np.repeat(np.arange(len(kept)), [len(x) for x in ids_a])
    doc_b = np.repeat(np.arange(len(kept)), [len(x) for x in ids_b])
    ia, ib = np.concatenate(ids_a), np.concatenate(ids_b)
    ends_a, ends_b = np.cumsum(len_a[ia]), np.cumsum(len_b[ib])
    # token ends at each byte and up to it: lookups in place of a search per end
    at_byte_a, at_byte_b = np.bincount(ends_a), np.bincount(ends_b)
    upto_a, upto_b = np.cumsum(at_byte_a), np.cumsum(at_byte_b)

    cuts = np.concatenate([[0], np.flatnonzero((at_byte_a > 0) & (at_byte_b > 0))])
    leaves = split_levels(cuts)
    first, last = cuts[leaves[:, 0]], cuts[leaves[:, 1]]
    a_lo, a_hi = upto_a[first], upto_a[last]
    b_lo, b_hi = upto_b[first], upto_b[last]
    doc_g = doc_a[a_hi - 1]

    # "a,a|b,b;" per group, the last of a text without ";"
    group_a = np.repeat(np.arange(len(leaves)), a_hi - a_lo)
    group_b = np.repeat(np.arange(len(leaves)), b_hi - b_lo)
    size = (a_hi - a_lo) + (b_hi - b_lo)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    at_a = start[group_a] + np.arange(len(ia)) - a_lo[group_a]
    at_b = start[group_b] + (a_hi - a_lo)[group_b] + np.arange(len(ib)) - b_lo[group_b]
    last_a = np.zeros(len(ia), dtype=bool)
    last_a[a_hi[a_hi > a_lo] - 1] = True
    last_b = np.zeros(len(ib), dtype=bool)
    last_b[b_hi[b_hi > b_lo] - 1] = True
    text_end = np.zeros(len(ib), dtype=bool)
    text_end[np.searchsorted(doc_b, np.arange(len(kept)), "right") - 1] = True
    items = np.empty(len(ia) + len(ib), dtype=object)
    items[at_a] = np.where(last_a, str_a["|"][ia], str_a[","][ia])
    items[at_b] = np.where(text_end, str_b[""][ib], np.where(last_b, str_b[";"][ib], str_b[","][ib]))
    text_items = np.bincount(doc_g, weights=size, minlength=len(kept)).astype(np.int64)
    item_end = np.cumsum(text_items)

    pieces = np.flatnonzero((at_byte_a > 0) | (at_byte_b > 0))
    la, lb = upto_a[pieces] - at_byte_a[pieces], upto_b[pieces] - at_byte_b[pieces]
    # text, A id and B id as one number, so that one plain sort brings equal pairs together
    keys = np.sort((doc_a[la] * len(a_bytes) + ia[la]) * len(b_bytes) + ib[lb])
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    mult = np.diff(np.append(starts, len(keys)))
    rest, pair_b = np.divmod(keys[starts], len(b_bytes))
    udocs, pair_a = np.divmod(rest, len(a_bytes))
    ukeys = (pair_a << 32) | pair_b
    doc_pairs_end = np.searchsorted(udocs, np.arange(len(kept)), "right")

    n_groups = np.bincount(doc_g, minlength=len(kept))
    for j, i in enumerate(kept):
        lo_item = item_end[j - 1] if j else 0
        lo_pair = doc_pairs_end[j - 1] if j else 0
        out[i] = {
            "n_a": len(ids_a[j]),
            "n_b": len(ids_b[j]),
            "n_groups": int(n_groups[j]),
            "groups": "".join(items[lo_item : item_end[j]]),
            "pairs": ukeys[lo_pair : doc_pairs_end[j]],
            "mult": mult[lo_pair : doc_pairs_end[j]],
        }
    return out


SCHEMA = (
    "_row long, _id long, n_a long, n_b long, n_groups long, groups_sha256 string, "
    "pairs array<long>, mult array<long>"
)


def tokenized(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, digest of the groups and the linked id pairs (written once)."""

    def run(batches):
        for batch in batches:
            rows, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            found = align_batch(texts)
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame(
                    {
                        "_row": rows,
                        "_id": pd.array(ids, dtype="Int64"),
                        "n_a": [f["n_a"] for f in found],
                        "n_b": [f["n_b"] for f in found],
                        "n_groups": [f["n_groups"] for f in found],
                        "groups_sha256": [hashlib.sha256(f["groups"].encode()).hexdigest() if f["groups"] else "" for f in found],
                        "pairs": [f["pairs"] for f in found],
                        "mult": [f["mult"] for f in found],
                    }
                ),
                preserve_index=False,
            )

    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_t")
    )
    return materialize(bounded_batches(rows).mapInArrow(run, SCHEMA), "alignments")


def alignment_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", salt: int = SALT) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    base = tokenized(docs, id_col, text)
    linked = base.select("_row", F.explode(F.arrays_zip("pairs", "mult")).alias("p")).select(
        "_row", F.col("p.pairs").alias("pair"), F.col("p.mult").alias("m")
    )
    counts = linked.groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("most"))
    rated = counts.join(top, F.shiftright("pair", 32) == F.col("a")).select(
        "pair", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best")
    )
    spread = rated.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    salted = linked.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salt)).cast("int"))
    per_doc = (
        salted.join(spread, ["pair", "_salt"])
        .groupBy("_row")
        .agg(
            F.sum("m").alias("n_links"),
            F.sum(F.col("m") * F.col("best")).alias("n_best"),
            F.sum(F.col("m") * F.col("docs")).alias("count_sum"),
        )
    )
    out = base.join(per_doc, "_row", "left").fillna(0, ["n_links", "n_best", "count_sum"])
    return out.select(
        F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
