"""Relative Lempel-Ziv parsing against plain loops over windows of words."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import substring_dedup
from millrace.llm.words import grams, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def plain(rows, window=20):
    """(id, number of words, removed, digest) of each row, in order of (id, text), nulls first."""
    seen, out = set(), []
    for i, text in sorted(((-(2**63) if i is None else i), t or "") for i, t in rows):
        w, cover = WORD.findall(text), set()
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if g in seen:
                cover.update(range(k, k + window))
            seen.add(g)
        kept = " ".join(x for k, x in enumerate(w) if k not in cover)
        out.append((i, len(w), len(cover), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found(df, **options):
    rows = substring_dedup.remove_repeats(df, **options).collect()
    return sorted((-(2**63) if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows), rows


def made(seed, n):
    """Texts stitched from shared passages of all lengths near the window's, with words of their own."""
    rng = np.random.default_rng(seed)
    passages = [" ".join(f"p{j}w{i}" for i in range(rng.integers(10, 70))) for j in range(12)]
    loop = " ".join(["la", "di"] * 25)
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.integers(1, 6)):
            kind = rng.integers(0, 5)
            p = passages[rng.integers(0, 12)].split()
            if kind < 2:
                parts += p
            elif kind == 2:
                a, b = sorted(rng.integers(0, len(p) + 1, 2))
                parts += p[a:b]
            elif kind == 3:
                parts += [f"own{i}x{j}" for j in range(rng.integers(1, 30))]
            else:
                parts += loop.split()[: rng.integers(1, 50)]
        rows.append((int(rng.integers(0, n)) if i % 9 == 0 else i, " ".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_windows(spark, seed):
    rows = made(seed, 150)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, chunk string, words string").repartition(3)
    assert found(df, block_bytes=1 << 10)[0] == plain(rows)


def test_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    x, y = thue_morse(12)
    rows = [(3, passage), (3, passage), (3, "z " + passage), (None, passage + " end"), (None, None), (5, ""), (None, "a " * 500), (7, "a " * 500), (8, "b c　d " * 40), (9, " ".join([x] * 20)), (10, " ".join([y] * 20)), (11, " ".join([x, y] * 15)), (12, " ".join([y, x] * 15)), (13, " ".join(f"w{i}" for i in range(19)))]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, _id string, chunk string")
    got, _ = found(df)
    assert got == plain(rows)
    assert next(r for r in got if r[0] == 10)[2] == 0
    out = substring_dedup.remove_repeats(df, texts=True)
    assert {"kept_text", "_id", "chunk"} <= set(out.columns) and out.where("_id = 'x' and chunk = 'y'").count() == len(rows)
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_a_document_that_only_repeats_itself(spark):
    rows = [(1, "a a a a " * 30), (2, " ".join(f"w{i % 25}" for i in range(100))), (3, " ".join(f"v{i}" for i in range(100)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1 << 8, 1 << 21):
        got, _ = found(df, block_bytes=size)
        assert got == plain(rows) and [r[2] for r in got] == [119, 75, 0]


def test_parse_takes_the_longest_factor_and_looks_across_boundaries():
    w = lambda name, n: [f"{name}{i}" for i in range(n)]
    a, b = w("a", 40), w("b", 40)
    reference = [a[:30], [*a, *b[:25]], b]
    segment = [*a, *b]
    s = words(pa.array([" ".join(segment)]))
    windows = grams(s, 20, 1)
    r = substring_dedup.Reference(pa.array([" ".join(x) for x in reference]), np.array([1, 2, 3]), np.unique(windows), 20)
    # the first place of the first window ends after 30 words, the second goes on into b; the rest is in the third text only
    assert r.parse(s, windows, 0, 80, 9) == [0, 65, 46, 80]
    # of documents from 2 on only the first places of windows count
    assert r.parse(s, windows, 0, 80, 2) == [0, 30, 11, 65, 46, 80]


def test_words_with_equal_hashes_are_compared():
    texts = [" ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" if i < 25 else f"v{i}" for i in range(40))]
    s = words(pa.array(texts[1:]))
    windows = grams(s, 20, 1)
    r = substring_dedup.Reference(pa.array(texts[:1]), np.array([1]), np.unique(windows), 20)
    r.words.hash[:] = 7
    s.hash[:] = 7
    assert r.parse(s, windows, 0, 40, 9) == [0, 25]
