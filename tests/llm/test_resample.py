"""Importance resampling against a plain computation of the contract."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from retentio.llm import queries, resample

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(text)


def plain(docs, bench, percent=10, min_words=20):
    def counts(texts):
        c = Counter()
        for t in texts:
            c.update(zlib.crc32(w.encode()) % 10000 for w in words(t))
        return c

    s, t = counts(d[1] for d in docs), counts(bench)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        ws = words(text)
        weight = sum(gain[zlib.crc32(w.encode()) % 10000] for w in ws)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = int(weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
        rows.append([doc_id, len(ws), weight, score, len(ws) >= min_words])
    eligible = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = percent * len(eligible) // 100
    rank = {id(r): i + 1 for i, r in enumerate(eligible[:drawn])}
    return sorted(((r[0], r[1], r[2], r[3], rank.get(id(r))) for r in rows), key=str)


def test_query_against_plain(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    bench = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op11_importance_resample"](spark, FOLDER).collect()), key=str)
    want = plain(docs, bench)
    assert len(got) == len(docs)
    assert got == want


def test_edges(spark):
    long_text = " ".join(["Word%d" % (i % 97) for i in range(30000)])
    docs = [
        (1, None),
        (2, ""),
        (3, "Ünïcode wörds and ABC abc " * 5),
        (3, "Ünïcode wörds and ABC abc " * 5),  # repeated row
        (None, "x " * 25),
        (5, long_text),
        (6, "one two"),
    ]
    bench = ["abc wörds", None, "word1 word2"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_id", F.lit(9)).withColumn("weight", F.lit(1))
    target = spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id long, text string")
    got = sorted(
        (tuple(r) for r in resample.resample(df, target, 50, 20).select("doc_id", "n_features", "weight", "score", "rank").collect()),
        key=lambda r: (r[0] is None, r[0] or 0, r[4] or 0),
    )
    want = sorted(plain(docs, bench, 50, 20), key=lambda r: (r[0] is None, r[0] or 0, r[4] or 0))
    assert got == want
    assert sum(r[4] is not None for r in got) == 2  # half of the four with 20 words or more


def test_cross_text_ngrams_are_masked():
    doc, keys, n_words = resample.features([b"a b", b"c", b"", b"d e f"], 2, 2, 10_000)
    assert n_words.tolist() == [2, 1, 0, 3]
    assert doc.tolist() == [0, 3, 3]
    assert keys.tolist() == [zlib.crc32(g) % 10_000 for g in (b"a b", b"d e", b"e f")]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(empty, empty).count() == 0


@pytest.mark.parametrize("text", ["ABC\x00def", "a b", "tab\tand\nline"])
def test_words_match_the_pattern(text):
    _, _, n = resample.features([text.encode()])
    assert n.tolist() == [len(words(text))]
