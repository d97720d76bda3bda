"""Cross-tokenizer alignment against plain all-pairs computations."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from retentio.llm import align, queries

FOLDER = "/root/testdata/sf0.001"


def plain(texts):
    """Per text: (n_a, n_b, groups text, list of linked (a, b) occurrences), all by brute force."""
    a = Tokenizer.from_file(align.A_FILE)
    a.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=align.B_FILE)
    alphabet = align.byte_alphabet()
    out = []
    for text in texts:
        if not text:
            out.append((0, 0, "", []))
            continue
        ia = a.encode(" " + text, add_special_tokens=False).ids
        ib = sp.encode(text)
        ba = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ia]
        bb = []
        for i in ib:
            p = sp.id_to_piece(i)
            bb.append(bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode())
        whole = (" " + text).encode()
        if b"".join(ba) != whole or b"".join(bb) != whole:
            out.append((0, 0, "", []))
            continue
        spans_a, spans_b, at = [], [], 0
        for p in ba:
            spans_a.append((at, at + len(p)))
            at += len(p)
        at = 0
        for p in bb:
            spans_b.append((at, at + len(p)))
            at += len(p)
        cuts = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        groups, start = [], 0
        for c in cuts:
            ga = [x for x, (s, e) in zip(ia, spans_a) if s >= start and e <= c]
            gb = [x for x, (s, e) in zip(ib, spans_b) if s >= start and e <= c]
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            start = c
        linked = [(x, y) for x, (s, e) in zip(ia, spans_a) for y, (t, f) in zip(ib, spans_b) if s < f and t < e]
        out.append((len(ia), len(ib), ";".join(groups), linked))
    return out


def report(ids, texts):
    found = plain(texts)
    docs = Counter(pair for _, _, _, linked in found for pair in set(linked))
    most = Counter()
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    rows = []
    for doc_id, (n_a, n_b, g, linked) in zip(ids, found):
        rows.append(
            (
                doc_id, n_a, n_b, len(g.split(";")) if g else 0, len(linked),
                sum(docs[p] == most[p[0]] for p in linked), sum(docs[p] for p in linked),
                hashlib.sha256(g.encode()).hexdigest() if g else "",
            )
        )
    return sorted(rows, key=str)


def test_query_against_plain(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in queries.QUERIES["op12_token_alignment"](spark, FOLDER).collect()), key=str)
    assert got == report([r.doc_id for r in rows], [r.text for r in rows])


def test_edges(spark):
    texts = [None, "", "Hello  world<|endoftext|> ünï\n\tx \U0001F600", "Hello  world", "Hello  world", "a" * 5000, " lead", "▁odd mark"]
    ids = [1, 2, 3, 4, 4, None, 7, 8]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("_row", F.lit(1)).withColumn("pairs", F.lit("x"))
    got = sorted((tuple(r) for r in align.alignment_report(df).collect()), key=str)
    assert got == report(ids, texts)


@pytest.mark.parametrize("seed", range(20))
def test_groups_cut_at_every_shared_end(seed):
    g = np.random.default_rng(seed)
    total = int(g.integers(1, 60))
    ends_a = np.unique(np.append(g.integers(1, total + 1, size=int(g.integers(1, 30))), total))
    ends_b = np.unique(np.append(g.integers(1, total + 1, size=int(g.integers(1, 30))), total))
    found = align.groups(ends_a, ends_b)
    shared = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    assert [int(ends_a[a_hi - 1]) for _, a_hi, _, _ in found] == shared
    assert [int(ends_b[b_hi - 1]) for _, _, _, b_hi in found] == shared
    ia, ib = align.links(ends_a, ends_b)
    sa = np.concatenate([[0], ends_a[:-1]])
    sb = np.concatenate([[0], ends_b[:-1]])
    brute = [(i, j) for i in range(len(ends_a)) for j in range(len(ends_b)) if sa[i] < ends_b[j] and sb[j] < ends_a[i]]
    assert list(zip(ia.tolist(), ib.tolist())) == brute


def test_cuts_and_links_are_looked_up_not_searched(monkeypatch):
    """A search per token end made the operator miss its CPU budget."""
    texts = ["der Fluß fließt 12345 naïvely", "a", None, "", "日本語 text <|endoftext|> x" * 3]
    expected = [align.groups(*_ends(t)) for t in texts if t]
    monkeypatch.setattr(align.np, "searchsorted", _search_of(align.np.searchsorted, limit=len(texts)))
    got = [f["n_groups"] for f in align.align_batch(texts) if f["n_a"]]
    assert got == [len(g) for g in expected]


def _ends(text):
    a, a_bytes, b, b_bytes = align.tokenizers()
    ia, ib = a.encode_ordinary(" " + text), b.encode(text)
    return tuple(align.np.cumsum([len(table[i]) for i in ids]) for table, ids in ((a_bytes, ia), (b_bytes, ib)))


def _search_of(search, limit):
    def checked(x, v, *args, **kwargs):
        assert len(align.np.atleast_1d(v)) <= limit, "a search per token end"
        return search(x, v, *args, **kwargs)

    return checked
