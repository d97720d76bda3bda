"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, per operator."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from retentio.llm import bpe, chats, hmm, mixing, quality, queries, rules, shards, simhash, sketches, spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, size int, shard string"
PASSAGE = " ".join(f"word{i}" for i in range(60))


def rows():
    long = " ".join(f"long{i} and{i % 13}" for i in range(30_000))
    texts = [
        (0, "the quick brown fox, it jumps. " * 3),
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, PASSAGE + " first ending"),
        (5, "another start " + PASSAGE),
        (6, long),
        (7, "same " * 80),
        (None, "no id at all " + PASSAGE),
        (8, "née Ångström's 中文 🙂 ### $$$ it's"),
        (8, "née Ångström's 中文 🙂 ### $$$ it's"),
        (9, "two rows of one id"),
        (9, "two rows of one id, other text"),
    ]
    return [
        (i, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None, 7, 8, "x") for k, (i, t) in enumerate(texts)
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def test_mixing(docs, none):
    def plan(d):
        return mixing.plan(d, queries.WEIGHTS, queries.CURRICULUM)

    found = plan(docs).toPandas()
    assert len(found) == len(rows())
    assert sorted(found["size"]) == sorted(len(words(r[1])) for r in rows())
    assert (found.taken <= 3 * found["size"]).all()
    by = found.fillna({"source": "-"}).groupby("source").agg({"source_size": "first", "size": "sum", "target": "first", "taken": "sum"})
    assert (by.source_size == by["size"]).all() and (by.taken <= by.target).all()
    assert plan(none).count() == 0
    mixed = mixing.mix(docs, plan(docs))
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(len(p) for p in found.positions)


def test_mixing_follows_the_schedule(spark):
    rows_ = [(i, "w " * 10, s) for i in range(400) for s in ("a", "b")]
    d = spark.createDataFrame([(i * 2 + (s == "b"), t, s) for i, t, s in rows_], "doc_id long, text string, source string")
    early = mixing.Schedule((0.0, 1.0), (2.0, 0.0))
    late = mixing.Schedule((0.0, 1.0), (0.0, 2.0))
    found = mixing.plan(d, (1.0, 1.0), (early, late)).select("source", F.explode("positions").alias("p")).toPandas()
    # demand t(2-t) and t*t: half of either is reached at 1-sqrt(1/2) and sqrt(1/2)
    assert abs(found[found.source == "a"].p.median() - (1 - 0.5**0.5)) < 0.01
    assert abs(found[found.source == "b"].p.median() - 0.5**0.5) < 0.01


def test_mixing_skips_what_does_not_fit(spark):
    import hashlib as h
    import random

    ids = sorted(range(400), key=lambda i: (h.md5(f"29|{i}".encode()).hexdigest()[:15], i))
    # "a": a document longer than the target comes first; "b": uneven sizes; "c": no tokens; "d": takes the rest
    r = random.Random(3)
    sizes = {i: ("a", 1000 if k == 0 else 10) for k, i in enumerate(ids[:51])}
    sizes |= {i: ("b", int(2 ** (r.random() * 9))) for i in ids[51:151]}
    sizes |= {i: ("c", 0) for i in ids[151:153]} | {i: ("d", 12) for i in ids[153:]}
    rows_ = [(i, "w " * n, s) for i, (s, n) in sizes.items()]
    d = spark.createDataFrame(rows_, "doc_id long, text string, source string").repartition(3)
    flat = mixing.Schedule((0.0, 1.0), (1.0, 1.0))
    found = mixing.plan(d, (0.4, 3.5, 1.0, 4.0), (flat,) * 4).toPandas()
    assert sorted(found.doc_id) == sorted(sizes)
    assert (found.taken == found["size"] * found.positions.map(len)).all() and found.positions.map(len).max() <= 3
    for source, part in found.groupby("source"):
        room = part.target.iloc[0] - part.taken.sum()
        open_to = part[(part["size"] > 0) & (part.positions.map(len) < 3)]
        assert room >= 0 and (open_to["size"] > room).all(), source
        # no tokens are demanded twice: with a flat schedule passes lie apart by half of each size
        spans_ = sorted((p * part.target.iloc[0], n) for ps, n in zip(part.positions, part["size"]) for p in ps if n)
        assert all(y - x >= (m + n) / 2 - 1e-6 for (x, m), (y, n) in zip(spans_, spans_[1:])), source
    a = found[found.source == "a"]
    assert a.target.iloc[0] < 1000 and a.target.iloc[0] - a.taken.sum() < 10 and a.taken.sum() > 400


def test_shards(docs, none):
    found = shards.manifest(docs, 40, ["doc_id"]).toPandas()
    assert len(found) == len(rows())
    assert Counter(found.text_crc32) == Counter(zlib.crc32((r[1] or "").encode()) for r in rows())
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert ((found.grown_shard == found["shard"]) | (found.grown_shard == 40)).all()
    assert shards.manifest(none, 40, ["doc_id"]).count() == 0
    assert set(shards.assign(docs, 4, ["doc_id"], "to").columns) == {*docs.columns, "to"}


def test_jump_moves_only_into_the_new_shard(spark):
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 1 << 60, 20_000).astype(np.uint64)
    for n in (1, 2, 7, 40, 200):
        a, b = shards.jump(keys, n), shards.jump(keys, n + 1)
        assert a.max(initial=0) < n and set(b[a != b].tolist()) <= {n}
        assert abs((a != b).mean() - 1 / (n + 1)) < 0.02


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(0, 1), (7, 0), (7, 0), (4, 1), (5, 1), (99, 1), (6, None)], "doc_id long, quality int")
    plain = docs.select("doc_id", "text")
    rows_ = quality.with_statistics(plain)
    model = quality.train(rows_, labels, F.lit(False))
    scores = [r.score for r in quality.with_scores(rows_, model).collect()]
    assert len(scores) == len(rows()) and all(0 <= s <= 1 for s in scores)
    empty = quality.with_statistics(none.select("doc_id", "text"))
    blank = quality.train(empty, labels, F.lit(False))
    assert quality.with_scores(empty, blank).count() == 0
    assert {r.score for r in quality.with_scores(rows_, blank).collect()} == {0.5}


def test_sketches(docs, none):
    found = sketches.edit_report(docs).toPandas()
    assert len(found) == len(rows())
    order = sorted(rows(), key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert sorted(found.n_chars) == sorted(len(r[1] or "") for r in rows())
    by_id = {r[0]: r[1] or "" for r in order}
    for i, after in ((7, 6), (6, 5), (5, 4), (4, 3), (3, 2), (2, 1), (1, 0), (0, None)):
        row = found[found.doc_id == i].iloc[0]
        text = sketches.edited(by_id[i], by_id[after])
        assert row.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
    twins = found[found.doc_id == 8]
    assert twins.fingerprint.nunique() == 1
    assert found.near_edited.between(0, 1).all() and found.near_next.between(0, 1).all()
    assert sketches.edit_report(none).count() == 0


def test_sketches_estimate_containment_and_merge():
    words_ = [f"w{i}" for i in range(4000)]
    part, whole, rest = (" ".join(w).encode() for w in (words_[:400], words_, words_[396:]))
    a, b, c = sketches.sketches_of([part, whole, rest])
    assert sketches.containment(a, b) == 1.0 and abs(sketches.containment(b, a) - 0.1) < 0.05
    bound, union = sketches.merged(a, c)
    assert (bound, union.tolist()) == (b[0], b[1].tolist())
    again = sketches.read(sketches.written(a))
    assert again[0] == a[0] and again[1].tolist() == a[1].tolist()


def test_rules(docs, none):
    kept = rules.accepted(docs)
    assert kept.columns == docs.columns
    assert set(r.n_words for r in kept.collect()) <= {7}  # a column of the table, not the statistic
    assert {4, 5, 6} <= {r.doc_id for r in kept.collect()}
    assert not {1, 2, 3, 7, 9} & {r.doc_id for r in kept.collect()}
    assert rules.accepted(none).count() == 0


def test_rule_weights_follow_the_votes():
    few = rules.RULES[:3]
    # the first two rules agree with each other, the third votes at random
    patterns = [((rules.BAD, rules.BAD, rules.ABSTAIN), 50), ((rules.BAD, rules.BAD, rules.BAD), 50)]
    patterns += [((rules.ABSTAIN, rules.ABSTAIN, rules.ABSTAIN), 450), ((rules.ABSTAIN, rules.ABSTAIN, rules.BAD), 450)]
    model = rules.estimate(patterns, few)
    assert abs(model.good - 0.9) < 0.02
    assert model.votes["symbols"][rules.BAD][rules.BAD] > 0.9
    assert abs(model.votes["shouting"][rules.GOOD][rules.BAD] - 0.5) < 0.05


def test_language_model(docs, none):
    def scored(d):
        held = queries._remainder("doc_id", 7) == 2
        table = hmm.blocks(d, held)
        known = hmm.vocabulary(table)
        model, history = hmm.train(table, known, passes=3)
        return hmm.score(table, known, model), history

    found, history = scored(docs)
    found = found.toPandas()
    assert Counter(found.n_tokens) == Counter(len(words(r[1])) + 1 for r in rows())
    assert history == sorted(history)  # Baum-Welch never lowers the likelihood (the prior is tiny here)
    assert (found.score < 0).all()
    assert scored(none)[0].count() == 0


def test_forward_recursion_is_exact():
    import numpy as np

    rng = np.random.default_rng(3)
    k, classes = 3, 7
    model = hmm.Model(*(rng.dirichlet(np.ones(n), size=m) if m else rng.dirichlet(np.ones(n)) for n, m in ((k, 0), (k, k), (classes, k))))
    lengths = np.array([1, 5, 64, 65, 200])
    kinds = rng.integers(0, classes, lengths.sum())
    *_, got = hmm.Chunks(kinds, lengths).ends(model)
    at = 0
    for n, value in zip(lengths, got):
        state, total = model.start, 0.0
        for s in kinds[at : at + n]:
            state = state @ model.move * model.emit[:, s]
            total += np.log(state.sum())
            state = state / state.sum()
        at += n
        assert abs(total - value) < 1e-9 * abs(total) + 1e-12
    starts, moves, emits, likelihood = hmm.Chunks(kinds, lengths).expected(model)
    assert abs(starts.sum() - 5) < 1e-9 and abs(moves.sum() - lengths.sum()) < 1e-6 and abs(emits.sum() - lengths.sum()) < 1e-6
    assert np.allclose(emits.sum(axis=0), np.bincount(kinds, minlength=classes))
    assert abs(likelihood - got.sum()) < 1e-6


def chat_rows():
    a, b, c = ("user", "hi"), ("assistant", "hello <|im_end|>"), ("user", None)
    logs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, c], 5: [a, b, c], 6: [("user", "HI")], None: [b]}
    return [(i, t, role, text, "extra") for i, turns in logs.items() for t, (role, text) in enumerate(turns)] + [(6, 0, "user", "HI", "extra")]


def test_chats(spark):
    schema = "conv_id long, turn int, role string, text string, position string"
    found = chats.format_chats(spark.createDataFrame(chat_rows(), schema)).toPandas()
    kept = {None if i != i else int(i): (int(g.n_turns.iloc[0]), int(g.copies.iloc[0])) for i, g in found.groupby("conv_id", dropna=False)}
    assert kept == {3: (3, 2), 4: (2, 1), 6: (1, 1), None: (1, 1)}
    text = "".join(found[found.conv_id == 3].sort_values("position").rendered)
    assert text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello < |im_end|><|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert chats.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_spans(docs, none):
    found = spans.without_repeats(docs.drop("n_words"), 35)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in found.collect())
    tokens = [words(r[1]) for r in rows()]
    times = Counter(tuple(t[i : i + 35]) for t in tokens for i in range(len(t) - 34))
    want = Counter()
    for r, t in zip(rows(), tokens):
        gone = set()
        for i in range(len(t) - 34):
            if times[tuple(t[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        want[(r[0], len(t), len(gone))] += 1
        if not gone:
            assert (r[0], len(t), 0, r[1]) in got  # untouched texts keep every character
    assert Counter(k[:3] for k in got.elements()) == want
    assert spans.without_repeats(none.drop("n_words"), 35).count() == 0
    with pytest.raises(ValueError):
        spans.without_repeats(docs.withColumn("_doc", F.lit(1)), 35)


def test_simhash(docs, none):
    found = simhash.near_duplicates(docs, 3, 2).toPandas()
    assert len(found) == len(rows())
    zero = found[found.doc_id.isin([1, 2, 3])]
    assert set(zero.fingerprint) == {0} and set(zero.component_id) == {1}
    kept = simhash.deduplicated(docs, 3, 2)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(8) == 1 and 1 in ids and 2 not in ids and 3 not in ids
    assert simhash.near_duplicates(none, 3, 2).count() == 0 and simhash.deduplicated(none, 3, 2).count() == 0


def test_simhash_decides_per_row(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    near_y, near_z = y.upper(), z.replace(" ", "  ")  # other texts with the same fingerprint
    rows_ = [
        (5, x, "5x"),  # alone in its component
        (5, near_y, "5y"),  # a near copy of 3 under the same id
        (3, y, "3y"),
        (None, z, "z1"),  # near copies without ids
        (None, near_z, "z2"),
        (None, z, "z1"),
        (None, near_y + " ", "no id"),  # never stays where there is an id
        (7, "seven " + PASSAGE, "a"),  # two texts of the least id in one component
        (7, ("seven " + PASSAGE).upper(), "b"),
    ]
    d = spark.createDataFrame(rows_, "doc_id long, text string, label string")
    kept = simhash.deduplicated(d, 3, 2)
    assert kept.columns == d.columns
    found = Counter(r.label[0] if r.doc_id is None else (r.doc_id if r.doc_id == 7 else r.label) for r in kept.collect())
    assert found == {"5x": 1, "3y": 1, "z": 1, 7: 1}


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_simhash_links_equal_brute_force(spark, bits):
    import random

    from retentio.llm.graphs import components

    r = random.Random(bits)
    values = {r.getrandbits(64) for _ in range(30)}
    for v in list(values):
        for _ in range(4):
            v ^= 1 << r.randrange(64)
            values.add(v)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    root = {v: v for v in signed}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in signed:
        for b in signed:
            if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    prints = spark.createDataFrame([(v,) for v in signed], "f long")
    got = {x.node: x.root for x in components(simhash.links(prints, bits)).collect()}
    assert {v: got.get(v, v) for v in signed} == {v: find(v) for v in signed}


def test_bpe(docs, none):
    import base64

    import numpy as np
    import tiktoken

    pairs = map(bytes.split, open(queries.RANKS, "rb"))
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    coded = bpe.encode(docs, queries.RANKS)
    for row in bpe.decode(coded, queries.RANKS).collect():
        text = row.text or ""
        assert row.ids == library.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode() and (row.token_ends or [0])[-1] == len(text.encode())
    assert bpe.encode(none, queries.RANKS).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs, queries.RANKS, ids="size")
    odd = ["'s's'll", "a'll '", "!'s", "   x", "\n's", " '", "x" * 500, "é中" * 90, "1" * 70, " 　 a"]
    flat, at = bpe.tokenizer_of(bpe.read_ranks(queries.RANKS)).encode([t.encode() for t in odd])
    for t, a, b in zip(odd, at, at[1:]):
        assert flat[a:b].tolist() == library.encode_ordinary(t)
    assert np.all(np.diff(at) > 0)


def test_pipeline(spark, docs, none):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for table in (docs.select(*names), none.select(*names)):
        current = table
        for name, stage in corpus_pipeline.STAGES:
            current = stage(spark, current, "")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert current.columns == names
                current = spark.createDataFrame(current.collect(), "doc_id long, text string, lang string, source string, n_chars long")
        assert "ids" in current.columns


def test_language_model_states_differ_on_short_texts(spark):
    """Ten-word texts only: seeds are joined blocks, states start apart and stay apart."""
    import numpy as np

    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        half = vocab[:30] if i % 2 else vocab[30:]  # two kinds of text
        rows.append((i, " ".join(rng.choice(half, size=10))))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    table = hmm.blocks(d, F.lit(False))
    known = hmm.vocabulary(table)
    model, history = hmm.train(table, known, passes=3)
    emit = np.asarray(model.emit)
    gap = max(np.abs(emit[a] - emit[b]).max() for a in range(len(emit)) for b in range(a))
    assert gap > 1e-4
    assert history[-1] > history[0]
