"""Registered queries against their SQL twins or brute force on the smallest tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
import xxhash

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import compare, connect
from retentio.llm import bpe, queries

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def lowered(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())


def test_every_operator_is_registered():
    for n in range(1, 11):
        assert any(name.startswith(f"op{n}_") for name in entry.queries())
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twins(spark, name):
    same, note = compare(spark, connect(FOLDER), FOLDER, entry.queries()[name], queries.SQL[name])
    assert same, note


def test_shard_law(spark, texts):
    found = entry.queries()["op3_jump_shards"](spark, FOLDER).collect()
    step, top = 2862933555777941757, 1 << 64

    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * step + 1) % top
            j = int((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
        return b

    for r in found:
        raw = texts[r.doc_id].encode()
        key = int(hashlib.md5(f"17|{r.doc_id}".encode()).hexdigest()[:15], 16)
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (jump(key, 40), jump(key, 41))
    assert len(found) == len(texts)


def test_rule_statistics(spark, texts):
    for r in entry.queries()["op5_quality_rules"](spark, FOLDER).collect():
        text = texts[r.doc_id]
        words = WORD.findall(text)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        base = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (len(words) < 50 or 100 * len(again) > 50 * len(words))
        assert not (r.kept and r.base_failed)


def test_rules_and_classifier_follow_the_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = [r for r in entry.queries()["op2_quality_discriminant"](spark, folder).collect() if r.doc_id in labels]
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.97 * len(held)
    kept = {r.doc_id: r.kept for r in entry.queries()["op5_quality_rules"](spark, folder).collect() if not r.base_failed}
    good = [kept[i] for i, q in labels.items() if q == 1 and i in kept]
    bad = [kept[i] for i, q in labels.items() if q == 0 and i in kept]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_language_model(spark, texts):
    tokens = {i: [*lowered(t).split(), None] for i, t in texts.items()}
    train = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(train.values()), len(train)
    gain = 0.0
    for r in entry.queries()["op6_hmm_scores"](spark, FOLDER).collect():
        ws = tokens[r.doc_id]
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws)
        assert math.isclose(base, r.base_score, rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(train[w] > 0 for w in ws), n)
        gain += (r.score - base) if r.held_out else 0.0
    assert gain > 0


def prints(text):
    words = lowered(text).split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values):
    root = {i: i for i in values}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(values)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (values[a] ^ values[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash(spark, texts):
    found = entry.queries()["op9_simhash"](spark, FOLDER).collect()
    values = {i: prints(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in found} == {i: f"{v:016x}" for i, v in values.items()}
    assert {r.doc_id: r.component_id for r in found} == components(values)


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, texts):
    encoding = library()
    for r in entry.queries()["op10_byte_bpe"](spark, FOLDER).collect():
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def stripped(texts, window=35):
    """Brute force of the repeated-span stage: which texts lose which words."""
    words = {i: t.encode().split() for i, t in texts.items()}
    times = Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
    kept = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - window + 1) if times[tuple(w[k : k + window])] > 1 for j in range(window)}
        kept[i] = [x for k, x in enumerate(w) if k not in gone]
    return kept


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, encoding = docs.columns, library()
    kept = {r.doc_id for r in entry.queries()["op5_quality_rules"](spark, FOLDER).filter("kept").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()} if name != "token_ids" else {}
        rows = docs.collect() if name == "token_ids" else []
        docs = corpus_pipeline.materialize(stage(spark, docs, FOLDER), "test")
        after = docs.collect()
        if name != "token_ids":
            assert docs.columns == columns
        if name == "quality":
            assert {r.doc_id for r in after} == kept and all(r == before[r.doc_id] for r in after)
        elif name == "near_copies":
            groups = components({i: prints(r.text) for i, r in before.items()})
            assert {r.doc_id for r in after} == set(groups.values()) and all(r == before[r.doc_id] for r in after)
        elif name == "repeated_spans":
            want = stripped({i: r.text for i, r in before.items()})
            assert {r.doc_id: r.text.encode().split() for r in after} == want
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "mixture":
            assert all(r == before[r.doc_id] for r in after)
            assert max(Counter(r.doc_id for r in after).values()) <= queries.MAX_REPEATS
            taken = entry_totals(after)
            assert sum(taken.values()) <= sum(len(r.text.encode().split()) for r in before.values())
        else:
            want = Counter((r.doc_id, tuple(encoding.encode_ordinary(r.text))) for r in rows)
            assert Counter((r.doc_id, tuple(r.ids)) for r in after) == want


def entry_totals(rows):
    totals = Counter()
    for r in rows:
        totals[r.source] += len(r.text.encode().split())
    return totals
