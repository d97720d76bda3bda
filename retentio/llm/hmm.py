"""A hidden Markov language model: latent states trained by Baum-Welch, exact scores by forward recursion.

Words are lower-cased (A-Z), and every text ends with one end token. A hidden state emits a word
class and the class emits the word, so an emission is P(class | state) * P(word | class). The
class of a word depends on the word alone: short words have (almost) their own, longer ones are
classed by their ending. There are ``classes`` of them, whatever the size of the vocabulary, so
the state tables stay small; word counts are a distributed table and are joined, never broadcast.

Texts are dealt into blocks of bounded token number: local word numbers, the words' hashes and
classes, and the length of each text. A pass of Baum-Welch is one job over the blocks, whose
expected counts are summed by class across partitions; at most classes x states numbers reach
the driver. Inside a block, texts are cut into short chunks that are advanced together: each
chunk's transition-emission product links its ends, so states and likelihoods are exact for
whole texts of any length.

Initial states come from at most ``SEEDS`` seeds: training texts of any length in the order of
their content hash, short ones joined into blocks of ``SEED_TOKENS`` tokens; only class counts
reach the driver. Each state is moved by a small seeded factor, so that even identical seeds give
states that Baum-Welch can tell apart. All texts count in every pass of training.

Defined results: null and empty texts are one end token; words not seen in training get their
class's share of one unseen word; repeated rows and null ids are scored as rows of their own;
without training texts the scores are those of the starting estimates; empty tables give empty
results. Other columns do not pass through: scores are a table of (doc_id, held_out, ...).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.llm.arrays import Words, bounded_batches, mixed, slices, span_hashes
from retentio.session import materialize

STATES, CLASSES, PASSES = 6, 1 << 14, 5
SEEDS, SEED_TOKENS = 240, 40  # seeds of starting states; short texts are joined into blocks of SEED_TOKENS
SEED_TEXTS = 16 * SEEDS  # texts with the smallest hashes that may form seeds (their hash and length reach the driver)
PERTURB, PERTURB_SEED = 0.02, 7  # each state's emissions start moved by up to 2 %, so states never start equal
BLOCK_TOKENS = 1 << 20
CHUNK = 64
SCALED = 8
SHORT, ENDING = 5, 3  # bytes: words up to SHORT are classed whole, others by their ENDING
END = np.uint64(1)  # hash of the end token, whose class is 0
PRIOR = 100.0


# --- texts to blocks ------------------------------------------------------------------------


def _tokens(texts: list[bytes], classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of every token of all texts (an end token after each), and token counts."""
    words = Words(texts)
    data = np.where((words.bytes >= 65) & (words.bytes <= 90), words.bytes + 32, words.bytes)
    hashes = span_hashes(data, words.starts, words.ends)
    long = words.ends - words.starts > SHORT
    endings = span_hashes(data, np.where(long, words.ends - ENDING, words.starts), words.ends)
    kinds = (mixed(endings + long.astype(np.uint64)) % np.uint64(classes - 1)).astype(np.int64) + 1
    at = words.first[1:]
    return np.insert(hashes, at, END), np.insert(kinds, at, 0), words.counts + 1


def _squeezed(values: np.ndarray) -> bytes:
    """Small numbers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _spread(value: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(value), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def blocks(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", classes: int = CLASSES) -> DataFrame:
    """Written table of blocks: ids, held, lengths, tokens (local word numbers), words, kinds, trained."""
    ids = docs.schema[doc_id].dataType
    schema = T.StructType(
        [
            T.StructField("block", T.StringType()),
            T.StructField("ids", T.ArrayType(ids)),
            T.StructField("held", T.ArrayType(T.BooleanType())),
            T.StructField("lengths", T.ArrayType(T.LongType())),
            T.StructField("tokens", T.BinaryType()),
            T.StructField("words", T.ArrayType(T.LongType())),
            T.StructField("kinds", T.ArrayType(T.IntegerType())),
            T.StructField("trained", T.ArrayType(T.LongType())),
        ]
    )

    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def block(parts, part: int, number: int):
        batches, hashes, kinds, counts = zip(*parts)
        hashes, kinds, counts = map(np.concatenate, (hashes, kinds, counts))
        words, first, local = np.unique(hashes, return_index=True, return_inverse=True)
        # frequent words get small numbers, which compress well
        order = np.argsort(-np.bincount(local), kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        local = rank[local]
        held = np.concatenate([np.asarray(b.column("held")) for b in batches])
        train = np.repeat(~held, counts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([f"{part}-{number}"]),
                one(pa.concat_arrays([b.column("doc_id") for b in batches])),
                one(pa.array(held)),
                one(pa.array(counts)),
                pa.array([_squeezed(local)], pa.binary()),
                one(pa.array(words[order].view(np.int64))),
                one(pa.array(kinds[first][order].astype(np.int32))),
                one(pa.array(np.bincount(local[train], minlength=len(words)))),
            ],
            names=schema.fieldNames(),
        )

    def run(batches):
        parts, held, number, part = [], 0, 0, None
        for batch, texts in slices(batches, "text"):
            part = int(batch.column("part")[0].as_py()) if part is None else part
            made = _tokens(texts, classes)
            if parts and held + len(made[0]) > BLOCK_TOKENS:
                yield block(parts, part, number)
                parts, held, number = [], 0, number + 1
            parts.append((batch, *made))
            held += len(made[0])
        if parts:
            yield block(parts, part, number)

    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held"),
        F.spark_partition_id().alias("part"),
    )
    return materialize(bounded_batches(narrow).mapInArrow(run, schema), "tokens")


@dataclass(frozen=True)
class Vocabulary:
    """Word counts of the training texts: a table, and what is summed of it by class."""

    counts: DataFrame  # word, c
    tokens: int
    words: int
    class_tokens: np.ndarray
    class_words: np.ndarray


def _word_rows(table: DataFrame) -> DataFrame:
    zipped = F.arrays_zip("words", "kinds", "trained")
    return table.select("block", F.posexplode(zipped).alias("number", "w")).select(
        "block", "number", F.col("w.words").alias("word"), F.col("w.kinds").alias("kind"), F.col("w.trained").alias("n")
    )


def vocabulary(table: DataFrame, classes: int = CLASSES) -> Vocabulary:
    counts = materialize(_word_rows(table).groupBy("word").agg(F.max("kind").alias("kind"), F.sum("n").alias("c")), "words")
    sums = counts.filter("c > 0").groupBy("kind").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    class_tokens, class_words = np.zeros(classes), np.zeros(classes)
    for row in sums:
        class_tokens[row.kind], class_words[row.kind] = row.c, row.v
    return Vocabulary(counts.select("word", "c"), int(class_tokens.sum()), int(class_words.sum()), class_tokens, class_words)


# --- the model ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # of the state before the first token
    move: np.ndarray  # state to state
    emit: np.ndarray  # state to class


class Chunks:
    """Texts of one block cut into chunks of ``CHUNK`` tokens that advance together.

    Chunks are held longest first, so that those still running at a step are the first ones.
    Vectors are scaled every ``SCALED`` steps, long before they could underflow.
    """

    def __init__(self, kinds: np.ndarray, lengths: np.ndarray):
        self.per_text = -(-lengths // CHUNK)
        first = np.cumsum(self.per_text) - self.per_text
        n = int(self.per_text.sum())
        text = np.repeat(np.arange(len(lengths)), self.per_text)
        size = np.minimum(lengths[text] - (np.arange(n) - first[text]) * CHUNK, CHUNK)
        inside = np.arange(CHUNK) < size[:, None]
        table = np.zeros((n, CHUNK), dtype=np.int64)
        table[inside] = kinds
        order = np.argsort(-size, kind="stable")
        self.first = first
        self.place = np.empty(n, dtype=np.int64)
        self.place[order] = np.arange(n)
        self.kinds = np.ascontiguousarray(table[order].T)
        self.running = np.searchsorted(-size[order], -np.arange(CHUNK), side="left")  # chunks longer than t

    def ends(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """State before each chunk, what follows each chunk, and natural log-likelihood of each text."""
        n, k = len(self.place), len(model.start)
        by_kind = np.ascontiguousarray(model.emit.T)
        product = np.broadcast_to(np.eye(k), (n, k, k)).copy()
        scratch = np.empty((n * k, k))
        scale = np.zeros(n)
        for t in range(CHUNK):
            m = self.running[t]
            if not m:
                break
            now = np.matmul(product[:m].reshape(-1, k), model.move, out=scratch[: m * k]).reshape(m, k, k)
            np.multiply(now, by_kind[self.kinds[t, :m]][:, None, :], out=product[:m])
            if t % SCALED == SCALED - 1:
                total = product[:m].sum(axis=(1, 2))
                product[:m] /= total[:, None, None]
                scale[:m] += np.log(total)
        before, after = np.empty((n, k)), np.empty((n, k))
        likelihood = np.zeros(len(self.first))
        state = np.tile(model.start, (len(self.first), 1))
        steps = int(self.per_text.max(initial=0))
        for j in range(steps):
            live = np.flatnonzero(self.per_text > j)
            chunk = self.place[self.first[live] + j]
            before[chunk] = state[live]
            now = np.einsum("ni,nij->nj", state[live], product[chunk])
            total = now.sum(axis=1)
            state[live] = now / total[:, None]
            likelihood[live] += np.log(total) + scale[chunk]
        rest = np.ones((len(self.first), k))
        for j in range(steps - 1, -1, -1):
            live = np.flatnonzero(self.per_text > j)
            chunk = self.place[self.first[live] + j]
            after[chunk] = rest[live]
            now = np.einsum("nij,nj->ni", product[chunk], rest[live])
            rest[live] = now / now.sum(axis=1)[:, None]
        return before, after, likelihood

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions of one pass, and the log-likelihood."""
        k = len(model.start)
        before, after, likelihood = self.ends(model)
        by_kind = np.ascontiguousarray(model.emit.T)
        steps = int(np.count_nonzero(self.running))
        ahead, seen_at = [before], []
        for t in range(steps):
            m = self.running[t]
            seen = by_kind[self.kinds[t, :m]]
            now = ahead[t][:m] @ model.move
            now *= seen
            if t % SCALED == SCALED - 1:
                now /= now.sum(axis=1)[:, None]
            ahead.append(now)
            seen_at.append(seen)
        moves, weights = np.zeros((k, k)), []
        back = after
        for t in range(steps - 1, -1, -1):
            m = self.running[t]
            part = back[:m]
            share = ahead[t + 1] * part
            total = share.sum(axis=1)[:, None]
            share /= total
            weights.append(share)
            seen = seen_at[t]
            seen *= part
            # chance of the whole text through this step, in the scale of ``ahead`` and ``back``
            through = ((ahead[t][:m] @ model.move) * seen).sum(axis=1)[:, None] if t % SCALED == SCALED - 1 else total
            moves += ahead[t][:m].T @ (seen / through)
            np.matmul(seen, model.move.T, out=part)
            if t % SCALED == 0:
                part /= part.sum(axis=1)[:, None]
        moves *= model.move
        flat = np.concatenate([self.kinds[t, : self.running[t]] for t in range(steps - 1, -1, -1)]) if steps else np.zeros(0, dtype=np.int64)
        weight = np.concatenate(weights).T if weights else np.zeros((k, 0))
        emits = np.stack([np.bincount(flat, weights=w, minlength=len(by_kind)) for w in weight])
        first = self.place[self.first[self.per_text > 0]]
        begin = model.start * back[first]
        return (begin / begin.sum(axis=1)[:, None]).sum(axis=0), moves, emits, float(likelihood.sum())


def _kept(row_lengths, keep: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and lengths of the texts to keep."""
    lengths = np.asarray(row_lengths)
    return tokens[np.repeat(keep, lengths)], lengths[keep]


def _pass(table: DataFrame, model: Model) -> tuple[Model, float]:
    """One pass of Baum-Welch over all training texts."""
    k, classes = model.emit.shape
    columns = [f"s{s}" for s in range(k)]
    schema = T.StructType([T.StructField("kind", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in columns]])

    def run(batches):
        # beside the classes: starts at -1, likelihood at -2, moves from state s at -3-s
        emits, others = np.zeros((k, classes)), np.zeros((k + 2, k))
        for batch in batches:
            for tokens, kinds, lengths, held in zip(*(batch.column(c) for c in ("tokens", "kinds", "lengths", "held"))):
                keep = ~np.asarray(held.values)
                sequence, sizes = _kept(lengths.values, keep, np.asarray(kinds.values)[_spread(tokens.as_py())])
                if len(sizes):
                    begin, moves, emitted, likelihood = Chunks(sequence, sizes).expected(model)
                    emits += emitted
                    others[0] += begin
                    others[1, 0] += likelihood
                    others[2:] += moves
        seen = np.flatnonzero(emits.sum(axis=0))
        names = np.concatenate([seen, -1 - np.arange(k + 2)]).astype(np.int32)
        values = np.concatenate([emits[:, seen].T, others])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), *[pa.array(np.ascontiguousarray(values[:, s])) for s in range(k)]], names=["kind", *columns]
        )

    found = table.select("tokens", "kinds", "lengths", "held").mapInArrow(run, schema)
    emits, others = np.zeros((k, classes)), np.zeros((k + 2, k))
    for row in found.groupBy("kind").agg(*[F.sum(c).alias(c) for c in columns]).collect():
        values = [row[c] for c in columns]
        if row.kind >= 0:
            emits[:, row.kind] = values
        else:
            others[-1 - row.kind] = values
    spread = emits.sum(axis=0) + 1.0
    emits += PRIOR * spread / spread.sum()
    moves = others[2:] + 1.0
    start = others[0] + 1.0
    return (
        Model(start / start.sum(), moves / moves.sum(axis=1)[:, None], emits / emits.sum(axis=1)[:, None]),
        float(others[1, 0]),
    )


def _selected(table: DataFrame):
    """Training texts (not held out, not empty) whose content hash falls below a share that
    leaves about ``SEED_TEXTS`` of them; as (own hash, tokens, class of each token)."""
    eligible = F.filter(F.arrays_zip("held", "lengths"), lambda x: ~x["held"] & (x["lengths"] > 0))
    n = table.agg(F.sum(F.size(eligible))).first()[0] or 0
    below = SEED_TEXTS / n if n > SEED_TEXTS else 1.0

    def texts(batch):
        for i in range(batch.num_rows):
            held, lengths, words, kinds = (np.asarray(batch.column(c)[i].values) for c in ("held", "lengths", "words", "kinds"))
            tokens = _spread(batch.column("tokens")[i].as_py())
            begin = np.cumsum(lengths) - lengths
            own = mixed(np.add.reduceat(mixed(words.view(np.uint64))[tokens], begin)) if len(lengths) else np.empty(0, np.uint64)
            for d in np.flatnonzero(~held & (lengths > 0) & (own.astype(np.float64) < below * 2.0**64)):
                yield int(own[d].view(np.int64)), kinds[tokens[begin[d] : begin[d] + lengths[d]]]

    return texts


def _seeds(table: DataFrame, classes: int) -> list[np.ndarray]:
    """Class counts of up to ``SEEDS`` seeds: the selected texts in hash order, short ones joined
    into blocks of at least ``SEED_TOKENS`` tokens. The driver receives (hash, length) of the
    selected texts and then the summed class counts of the blocks, never tokens."""
    texts = _selected(table)
    columns = table.select("held", "lengths", "words", "kinds", "tokens")

    def lengths(batches):
        for batch in batches:
            found = list(texts(batch))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o for o, _ in found], pa.int64()), pa.array([len(k) for _, k in found], pa.int64())],
                names=["own", "n"],
            )

    heads = columns.mapInArrow(lengths, "own long, n long").groupBy("own").agg(F.first("n").alias("n"))
    block, held, at = {}, 0, 0
    for row in heads.orderBy("own").limit(SEED_TEXTS).collect():  # at most SEED_TEXTS pairs
        if at == SEEDS:
            break
        block[row["own"]] = at
        held += row["n"]
        if held >= SEED_TOKENS:
            at, held = at + 1, 0
    if not block:
        return []

    def counts(batches):
        for batch in batches:
            rows = [(o, block[o], np.unique(k, return_counts=True)) for o, k in texts(batch) if o in block]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.full(len(c), o, np.int64) for o, _, (c, _) in rows]) if rows else [], pa.int64()),
                    pa.array(np.concatenate([np.full(len(c), b, np.int64) for _, b, (c, _) in rows]) if rows else [], pa.int64()),
                    pa.array(np.concatenate([c for _, _, (c, _) in rows]).astype(np.int64) if rows else [], pa.int64()),
                    pa.array(np.concatenate([m for _, _, (_, m) in rows]).astype(np.int64) if rows else [], pa.int64()),
                ],
                names=["own", "block", "kind", "n"],
            )

    # each repeated text counts once, as it was chosen once by its hash
    summed = (
        columns.mapInArrow(counts, "own long, block long, kind long, n long")
        .groupBy("own", "block", "kind")
        .agg(F.max("n").alias("n"))
        .groupBy("block", "kind")
        .agg(F.sum("n").alias("n"))
        .collect()  # at most SEEDS x classes entries
    )
    seen = np.zeros((max(block.values()) + 1, classes))
    for row in summed:
        seen[row["block"], row["kind"]] += row["n"]
    return [r for r in seen if r.sum() > 0]


def _seeded(table: DataFrame, states: int, classes: int, spread: np.ndarray) -> Model:
    """Starting states: the class counts of groups of seeds that differ most, each state then
    moved by its own small seeded factor, so that no two states start equal."""
    rows = _seeds(table, classes)
    spread = (spread + 1.0) / (spread + 1.0).sum()
    emit = np.tile(spread, (states, 1))
    if rows:
        seen = np.stack(rows)
        shape = np.sqrt(seen / seen.sum(axis=1)[:, None])
        chosen = [int(np.argmax(shape @ shape.sum(axis=0)))]
        for _ in range(1, min(states, len(rows))):
            chosen.append(int(np.argmin((shape @ shape[chosen].T).max(axis=1))))
        centres = shape[chosen]
        for _ in range(5):
            near = np.argmax(shape @ centres.T, axis=1)
            centres = np.stack([shape[near == s].sum(axis=0) if (near == s).any() else c for s, c in enumerate(centres)])
            centres /= np.linalg.norm(centres, axis=1)[:, None]
        for s in np.unique(near):  # states without a seed start from all texts
            # the update of a pass, with its prior, applied to the seeds of the state
            own = seen[near == s].sum(axis=0) + PRIOR * spread
            emit[s] = own / own.sum()
    emit *= np.random.default_rng(PERTURB_SEED).uniform(1 - PERTURB, 1 + PERTURB, size=emit.shape)
    emit /= emit.sum(axis=1)[:, None]
    move = np.full((states, states), 0.04 / max(states - 1, 1))
    np.fill_diagonal(move, 0.96 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit)


def train(table: DataFrame, words: Vocabulary, states: int = STATES, passes: int = PASSES) -> tuple[Model, list[float]]:
    """Model and the log-likelihood of the training texts before each pass."""
    model = _seeded(table, states, len(words.class_tokens), words.class_tokens)
    history = []
    for _ in range(passes):
        model, likelihood = _pass(table, model)
        history.append(likelihood)
    return model, history


def score(table: DataFrame, words: Vocabulary, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    ids = table.schema["ids"].dataType.elementType
    numbers = F.collect_list(F.struct("number", "c"))
    known = _word_rows(table).select("block", "number", "word").join(words.counts, "word").groupBy("block").agg(numbers.alias("known"))
    joined = table.select("block", "ids", "held", "lengths", "tokens", "kinds").join(known, "block")
    schema = T.StructType(
        [
            T.StructField("doc_id", ids),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("train_tokens", T.LongType()),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    total, distinct = words.tokens, words.words
    room = words.class_tokens + words.class_words + 1.0

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("ids", "held", "lengths", "tokens", "kinds", "known")}
                kinds, lengths = np.asarray(row["kinds"].values), np.asarray(row["lengths"].values)
                pairs = row["known"].values
                seen = np.zeros(len(kinds), dtype=np.int64)
                seen[np.asarray(pairs.field("number"))] = np.asarray(pairs.field("c"))
                tokens = _spread(row["tokens"].as_py())
                base = np.log10((seen + 1.0) / (total + distinct + 1.0))
                within = np.log10((seen + 1.0) / room[kinds])
                begin = np.cumsum(lengths) - lengths
                *_, likelihood = Chunks(kinds[tokens], lengths).ends(model)
                sums = [np.add.reduceat(v[tokens], begin) for v in ((seen > 0).astype(np.int64), base, within)]
                yield pa.RecordBatch.from_arrays(
                    [
                        row["ids"].values,
                        row["held"].values,
                        pa.array(lengths),
                        pa.array(sums[0]),
                        pa.array(np.full(len(lengths), total)),
                        pa.array(sums[1]),
                        pa.array(sums[2] + likelihood / np.log(10.0)),
                    ],
                    names=schema.fieldNames(),
                )

    return bounded_batches(joined).mapInArrow(run, schema)
