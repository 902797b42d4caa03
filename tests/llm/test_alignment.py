"""op11 against plain loops with both tokenizers on whole texts."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import alignment

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PAIR = alignment.Pair(A, B)
TEXTS = [
    "the cat sat on the mat, the end", "the cat  sat\non\tthe   mat ", None, "", " ", "   ", "\n", "  the", "the ", "don't we'll  'tis", "café naïve 漢字 仮名  漢", "x y 　z  w",
    "a▁b the cat", "▁", "<|endoftext|> <s> </s> <0x41>", "\x00\x01 ﻿​", "the cat sat on the mat, the end", "é ́x \U0001f600\U0001f1e9 אב", "12345 6789, #$%  --  ==",
    "the " * 3000, "x" * 5000, "漢字" * 2000, "a" + " " * 300 + "b", "q\x1f \x1e w\x85 e", "the cat   sat",
]


def brute(rows):
    p = PAIR
    a, b = p.a, p.b
    found, counts = [], Counter()
    for doc, text in rows:
        groups, links, n = [], [], (0, 0)
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            raw = (" " + text).encode()
            if b"".join(p.a_bytes[i] for i in x) == raw == b"".join(p.b_bytes[i] for i in y):
                n = len(x), len(y)
                ends = [dict(zip(np.cumsum([len(of[i]) for i in ids]).tolist(), range(1, len(ids) + 1), strict=True)) for ids, of in ((x, p.a_bytes), (y, p.b_bytes))]
                i = j = 0
                for at in sorted(set(ends[0]) & set(ends[1])):
                    k, m = ends[0][at], ends[1][at]
                    groups.append(",".join(map(str, x[i:k])) + "|" + ",".join(map(str, y[j:m])))
                    links.append((x[k - 1], y[m - 1]))
                    i, j = k, m
        counts.update(links)
        found.append((doc, *n, groups, links))
    top = Counter()
    for (_, y), c in counts.items():
        top[y] = max(top[y], c)
    return [
        (doc, n, m, len(g), len(l), sum(counts[x] == top[x[1]] for x in l), sum(counts[x] for x in l), hashlib.sha256(";".join(g).encode()).hexdigest() if n else "") for doc, n, m, g, l in found
    ], counts


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else x for x in row)


@pytest.mark.parametrize("block", [1 << 25, 64])
def test_align(spark, block):
    rows = [*enumerate(TEXTS), (None, "the cat"), (3, "the mat"), (0, TEXTS[0])]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, local int, block string").repartition(3)
    found, pairs = alignment.align(docs, A, B, block_bytes=block)
    want, counts = brute(rows)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    pairs = pairs.collect()
    assert {(r.a, r.b): r["count"] for r in pairs} == dict(counts)
    docs_of = Counter(x for _, t in rows for x in set(brute([(0, t)])[1]))
    assert {(r.a, r.b): r.n_docs for r in pairs} == dict(docs_of)
    assert len(pairs) <= PAIR.most_pairs() < 2_000_000


def test_empty(spark):
    found, pairs = alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert found.count() == 0 and pairs.count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want, _ = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(tuple, alignment.align(docs, A, B, block_bytes=1 << 14)[0].collect())) == sorted(want)


def test_random_texts():
    rng = np.random.default_rng(5)
    signs = list("ab tTh'se \n\t.,;0é 　漢▁\U0001f600\x1f")
    table = alignment.Pieces(PAIR, most=5000)
    for _ in range(60):
        texts = [" " + "".join(rng.choice(signs, rng.integers(1, 60))) for _ in range(30)]
        w = alignment.cut_texts(pa.array(texts))
        parts = [w.data[x:y].tobytes() for x, y in zip(w.first, w.last, strict=True)]
        entry = dict(zip(list(dict.fromkeys(parts)), table.find(list(dict.fromkeys(parts))), strict=True))
        for d, text in enumerate(texts):
            groups = [table.groups[entry[x]] for x, doc in zip(parts, w.doc, strict=True) if doc == d]
            sha = "" if None in groups else hashlib.sha256(b";".join(groups)).hexdigest()
            assert sha == brute([(0, text[1:])])[0][0][-1], text


def test_sets():
    rng = np.random.default_rng(3)
    for n_docs in (1, 7, 8, 40, 3000, 1 << 15):
        members = [np.flatnonzero(rng.random(n_docs) < p) for p in (0, 0.01, 0.3, 0.9, 1)]
        of = np.repeat(np.arange(5), [len(x) for x in members])
        data, at = alignment.pack_sets(of, np.concatenate(members), 5, n_docs)
        which, docs = alignment.unpack_sets(data, at)
        for i, x in enumerate(members):
            assert sorted(docs[which == i].tolist()) == x.tolist()
