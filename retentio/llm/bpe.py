"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

A text's code points are looked up in a class table. A small automaton over the classes says
where tokens begin; every class is a function from states to states, and since composing such
functions is associative, all states inside a block of text come from a scan over composed
functions instead of a walk along the text. No regular expression is run. The byte slices
between token beginnings are merged by rank, with a bounded cache of the slices seen.

Defined results: a null text is an empty one, with no ids; special tokens do not exist, so
their names are ordinary text; empty tables give empty results; other columns pass through,
and the names of the added columns are parameters. A text of any length is one row: it is
scanned in blocks with the state carried over, and no prefix is cut.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from retentio.llm.arrays import SECOND, bounded_batches, slices, span_hashes

# fixed value: the published pattern whose slices the automaton finds (used to probe classes only)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
CACHED = 1 << 18  # slices in each of the two generations of a worker's cache
CACHED_BYTES = 64  # longer slices are merged anew each time
NO_RANK = 1 << 62

# symbols: classes refined by what follows in the same text
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_JOIN, S_LAST, S_MORE = range(8)
# states: which run the next code point may extend
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINED, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """Class of every code point, as the tokenizer library has them.

    The interpreter's Unicode tables give the classes of the code points they know. Those they
    don't know, in the planes that hold scripts, are asked of the library: a letter, digit or
    white space stays in one slice with another of its kind, and only pairs within a slice merge.
    """
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    unknown = []
    for point in range(0x110000):
        category = unicodedata.category(chr(point))
        if category[0] == "L":
            table[point] = LETTER
        elif category[0] == "N":
            table[point] = NUMBER
        elif category == "Cn" and point < 0x40000:
            unknown.append(point)
    white = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[white] = WHITE
    table[0x20] = SPACE
    pairs = [bytes([first, second]) for first in b"a1" for second in range(256)]
    ranks = {token: rank for rank, token in enumerate([*(bytes([b]) for b in range(256)), *pairs])}
    probe = tiktoken.Encoding("classes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for kind, first in ((LETTER, "a"), (NUMBER, "1")):
        for point in unknown:
            text = first + chr(point)
            if len(probe.encode_ordinary(text)) == len(text.encode()) - 1:
                table[point] = kind
    return table


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and 'a token begins here', both indexed by symbol * 8 + state."""
    step = np.zeros((16, 8), dtype=np.uint8)
    begins = np.ones((16, 8), dtype=bool)

    def rule(symbol, to, extends=()):
        step[symbol] = to
        for state in extends:
            begins[symbol, state] = False

    rule(S_LETTER, IN_LETTERS, (IN_LETTERS, JOINED, ONE_LEFT, TWO_LEFT))
    step[S_LETTER, TWO_LEFT], step[S_LETTER, ONE_LEFT] = ONE_LEFT, FRESH
    rule(S_NUMBER, IN_NUMBERS, (IN_NUMBERS, JOINED))
    rule(S_OTHER, IN_OTHERS, (IN_OTHERS, JOINED))
    for symbol, left in ((S_SHORT, ONE_LEFT), (S_LONG, TWO_LEFT)):  # apostrophe of 's or 'll
        rule(symbol, left, (IN_OTHERS, JOINED))
        step[symbol, [IN_OTHERS, JOINED]] = IN_OTHERS
    rule(S_JOIN, JOINED)  # a space before something else starts that token
    rule(S_LAST, FRESH)  # other white space before something else stands alone
    rule(S_MORE, IN_WHITE, (IN_WHITE,))
    step[8:] = step[:8, [FRESH]]  # the first code point of a text starts afresh
    return step.ravel(), begins.ravel()


STEP, BEGINS = _automaton()
WIDTH = 64


def _then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Composition of state functions, rows of eight results each."""
    return np.take_along_axis(second, first, axis=1)


def token_begins(symbols: np.ndarray, state: int = FRESH) -> tuple[np.ndarray, int]:
    """Whether a token begins at each symbol, and the state after the last one."""
    n = len(symbols)
    if not n:
        return np.zeros(0, dtype=bool), state
    rows = -(-n // WIDTH)
    padded = np.zeros(rows * WIDTH, dtype=np.int64)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(rows, WIDTH).T) * 8
    # what each row of symbols does to every state
    whole = np.tile(np.arange(8)[:, None], (1, rows))
    for column in columns:
        whole = STEP[whole + column]
    scanned = whole.T.astype(np.int64)
    shift = 1
    while shift < rows:  # inclusive scan by composition
        scanned[shift:] = _then(scanned[:-shift].copy(), scanned[shift:])
        shift *= 2
    now = np.empty(rows, dtype=np.int64)
    now[0] = state
    now[1:] = scanned[:-1, state]
    out = np.empty((WIDTH, rows), dtype=bool)
    last_row, last_column = divmod(n - 1, WIDTH)
    end = state
    for j, column in enumerate(columns):
        at = now + column
        out[j] = BEGINS[at]
        now = STEP[at]
        if j == last_column:
            end = int(now[last_row])
    return out.T.reshape(-1)[:n], end


def symbols_of(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbol of every code point; ``first`` marks the first code point of each text."""
    n = len(points)
    kind = code_point_classes()[points]
    ends = np.append(first[1:], True)  # last code point of its text

    def following(k: int) -> np.ndarray:
        """k-th next code point inside the text, else 0."""
        out = np.zeros(n, dtype=points.dtype)
        out[: n - k] = points[k:]
        for j in range(k):
            out[: n - j] = np.where(ends[j:], 0, out[: n - j])
        return out

    white = (kind == SPACE) | (kind == WHITE)
    solid_next = np.append(~white[1:], False) & ~ends
    symbol = kind.copy()
    symbol[white] = S_MORE
    symbol[(kind == SPACE) & solid_next] = S_JOIN
    symbol[(kind == WHITE) & solid_next] = S_LAST
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        one, two = following(1)[quotes], following(2)[quotes]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        symbol[quotes[short]] = S_SHORT
        symbol[quotes[long]] = S_LONG
    return symbol + 8 * first.astype(np.uint8)


def slices_of(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts in one buffer, byte offsets at which tokens begin, and of each text the first of them."""
    buffer = b"".join(texts)
    points = np.frombuffer(buffer.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    raw = np.frombuffer(buffer, dtype=np.uint8)
    leads = np.flatnonzero((raw & 0xC0) != 0x80)  # byte offset of every code point
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))])
    first = np.zeros(len(points), dtype=bool)
    filled = offsets[:-1][np.diff(offsets) > 0]
    first[np.searchsorted(leads, filled)] = True
    begins, _ = token_begins(symbols_of(points, first)) if len(points) else (first, FRESH)
    starts = leads[begins]
    return buffer, np.append(starts, len(buffer)), np.searchsorted(starts, offsets)


class Tokenizer:
    """Ranks of byte strings; ids are the ranks."""

    def __init__(self, lines: bytes):
        pairs = (line.split() for line in lines.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        top = tokens[-1][1] + 1 if tokens else 0
        self.lengths = np.zeros(top, dtype=np.int64)
        self.places = np.zeros(top, dtype=np.int64)
        self.known = np.zeros(top, dtype=bool)
        at = 0
        for token, rank in tokens:
            self.lengths[rank], self.places[rank], self.known[rank] = len(token), at, True
            at += len(token)
        self.blob = np.frombuffer(b"".join(token for token, _ in tokens), dtype=np.uint8)
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: the adjacent pair of lowest rank is joined first, leftmost at ties."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > CACHED_BYTES:
            return self.merge_long(piece)
        get, bounds = ranks.get, list(range(len(piece) + 1))
        pairs = [get(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
        while pairs:
            lowest = min(pairs)
            if lowest == NO_RANK:
                break
            i = pairs.index(lowest)
            del bounds[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(piece[bounds[i] : bounds[i + 2]], NO_RANK)
            if i:
                pairs[i - 1] = get(piece[bounds[i - 1] : bounds[i + 1]], NO_RANK)
        return [ranks[piece[a:b]] for a, b in zip(bounds, bounds[1:])]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same for slices of any length: pairs wait in a heap, parts form a linked list."""
        ranks = self.ranks
        n = len(piece)
        end = list(range(1, n + 1))  # end of the part that begins here; 0 once joined to the left
        before = list(range(-1, n - 1))
        heap = [(ranks[pair], i, i + 2) for i in range(n - 1) if (pair := piece[i : i + 2]) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two parts has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                far = end[stop]
                rank = ranks.get(piece[i:far])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, far))
            left = before[i]
            if left >= 0:
                rank = ranks.get(piece[left:stop])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _ids(self, piece: bytes) -> bytes:
        """Packed ids of one slice, from the cache if it is there."""
        ids = self.cache.get(piece)
        if ids is None:
            ids = self.older.get(piece) or array("I", self.merge(piece)).tobytes()
            if len(piece) <= CACHED_BYTES:
                if len(self.cache) >= CACHED:
                    self.older, self.cache = self.cache, {}
                self.cache[piece] = ids
        return ids

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offset at which each text begins.

        Equal slices of a block are found by hash (a second hash confirms them) and merged once.
        """
        buffer, bounds, firsts = slices_of(texts)
        starts, ends = bounds[:-1], bounds[1:]
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        data = np.frombuffer(buffer, dtype=np.uint8)
        _, shown, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        second = span_hashes(data, starts, ends, SECOND)
        if not np.array_equal(second, second[shown[which]]):
            shown = which = np.arange(len(starts))
        packed = [self._ids(buffer[a:b]) for a, b in zip(starts[shown].tolist(), ends[shown].tolist())]
        sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        places = np.cumsum(sizes) - sizes
        counts = sizes[which]
        stops = np.cumsum(counts)
        index = np.repeat(places[which] - (stops - counts), counts) + np.arange(stops[-1])
        flat = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)[index]
        return flat, np.concatenate([[0], stops])[firsts]

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset at which each token ends in its text."""
        if len(ids) and (ids.max() >= len(self.known) or ids.min() < 0 or not self.known[ids].all()):
            raise ValueError("an id has no token")
        return np.cumsum(self.lengths[ids])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bytes of the tokens, each put where its offset says."""
        if not len(ids):
            return np.zeros(0, dtype=np.uint8)
        lengths = np.diff(ends, prepend=0)
        if not np.array_equal(lengths, self.lengths[ids]):
            raise ValueError("the offsets do not belong to the ids")
        source = np.repeat(self.places[ids] - (ends - lengths), lengths)
        source += np.arange(len(source))
        return self.blob[source]


@lru_cache(maxsize=4)
def tokenizer_of(lines: bytes) -> Tokenizer:
    """One tokenizer per worker and rank file, so that its cache outlives a task."""
    return Tokenizer(lines)


def read_ranks(path: str) -> bytes:
    """The rank file, read once on the driver; its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return f.read()


def _with_fields(schema: T.StructType, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    clash = {n for n, _ in fields} & set(schema.fieldNames())
    if clash:
        raise ValueError(f"the table already has columns {sorted(clash)}; choose other names")
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in fields]])


def encoded_batches(batches, lines: bytes, text: str, names: list[str]):
    """Arrow batches with the ids and token ends added, cut to blocks of bounded text."""
    tokenizer = tokenizer_of(lines)
    for batch, texts in slices(batches, text):
        flat, offsets = tokenizer.encode(texts)
        counts, offsets = np.diff(offsets), offsets.astype(np.int32)
        total = tokenizer.ends(flat)
        before = np.concatenate([[0], total])[offsets[:-1]]
        stops = total - np.repeat(before, counts)
        added = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)) for values in (flat, stops)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)


def decoded_batches(batches, lines: bytes, ids: str, ends: str, names: list[str]):
    """Arrow batches with the bytes that the ids stand for added."""
    tokenizer = tokenizer_of(lines)
    for batch in batches:
        values = []
        for row, stops in zip(batch.column(ids), batch.column(ends)):
            numbers = np.asarray(row.values) if row.is_valid else np.zeros(0, dtype=np.int64)
            given = np.asarray(stops.values) if stops.is_valid else tokenizer.ends(numbers)
            values.append(tokenizer.decode(numbers, given).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary())], names=names)


def encode(docs: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", ends: str = "token_ends") -> DataFrame:
    """Add the ids of every whole text and the byte offset at which each token ends."""
    lines = read_ranks(ranks_path)
    numbers = T.ArrayType(T.IntegerType(), containsNull=False)
    schema = _with_fields(docs.schema, [(ids, numbers), (ends, T.ArrayType(T.LongType(), containsNull=False))])
    names = schema.fieldNames()
    return bounded_batches(docs).mapInArrow(lambda batches: encoded_batches(batches, lines, text, names), schema)


def decode(coded: DataFrame, ranks_path: str, ids: str = "ids", ends: str = "token_ends", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for; null ids give no bytes."""
    lines = read_ranks(ranks_path)
    schema = _with_fields(coded.schema, [(out, T.BinaryType())])
    names = schema.fieldNames()
    return bounded_batches(coded).mapInArrow(lambda batches: decoded_batches(batches, lines, ids, ends, names), schema)


def round_trip(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """Every row but its text, with n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit numbers) and decoded_sha256.

    The steps of :func:`encode` and :func:`decode` follow each other batch by batch in one
    worker, so neither ids nor decoded bytes of more than a block are held.
    """
    lines = read_ranks(ranks_path)
    kept = [c for c in docs.columns if c != text]
    schema = _with_fields(
        docs.select(*kept).schema,
        [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())],
    )
    names, columns = schema.fieldNames(), docs.columns

    def run(batches):
        coded = encoded_batches(batches, lines, text, [*columns, "_ids", "_ends"])
        for batch in decoded_batches(coded, lines, "_ids", "_ends", [*columns, "_ids", "_ends", "_bytes"]):
            ids = [np.asarray(row.values).astype("<u4") for row in batch.column("_ids")]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in kept],
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(b.as_py()).hexdigest() for b in batch.column("_bytes")]),
                ],
                names=names,
            )

    return bounded_batches(docs).mapInArrow(run, schema)
