"""Streaming Viterbi against full dynamic programming, on texts far longer than its window."""

import numpy as np
import pytest

from millrace.llm.sentencepiece_viterbi import Vocabulary, decode, encode

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(P.path("piece_bpe_32k.model"))


def known_scores(v):
    out, stack = {}, [("", v.trie)]
    while stack:
        text, node = stack.pop()
        for k, x in node.items():
            if k == "":
                out[text] = x
            else:
                stack.append((text + k, x))
    return out


def best_score(v, scores, text):
    best = [0.0] + [-np.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - v.longest), j):
            s = scores[text[i:j]][1] if text[i:j] in scores else v.unknown_score if j - i == 1 else -np.inf
            best[j] = max(best[j], best[i] + s)
    return best[-1]


def texts(scores):
    rng = np.random.default_rng(5)
    plain = [p for p in scores if p.isalpha() and len(p) > 1]
    for n in range(300):
        joined = "".join(rng.choice(plain, 60))
        yield [joined, "▁" + joined.replace("e", "e▁"), joined[::-1], "".join(rng.choice(list("aeinst▁ö☃"), 250))][n % 4]
    yield "internationalization" * 10
    yield "a" * 400
    yield "=" * 400
    yield "☃" * 300


def test_stream_equals_full_dynamic_programming(vocabulary):
    v, scores = vocabulary, known_scores(vocabulary)
    of = {i: s for i, s in scores.values()}
    n_commits = early = 0
    for text in texts(scores):
        commits, ids = [], []
        for part in v.stream(text, commits):
            ids += part
        raw = b"".join(v.bytes_of[i] for i in ids).decode()
        assert raw == text.replace("▁", " ")
        unknown = sum(c not in scores for c in text)
        assert sum(of.get(i, 0.0) for i in ids) + unknown * v.unknown_score == pytest.approx(best_score(v, scores, text), abs=1e-3)
        assert len(set(text)) < 3 or max(w for w, _ in commits) <= 8 * v.longest
        n_commits, early = n_commits + len(commits), early + sum(c > 0 for _, c in commits)
    assert early > 0.9 * n_commits > 2000


def test_texts_come_back_as_they_were(spark, vocabulary):
    odd = ["a▁b ▁ c▁▁", "▁", " ", "  two  ", "", None, "x" * 30000, " \t\nmixed ☃ é", "internationalization" * 50]
    df = spark.createDataFrame([(i, t, "kept", "kept") for i, t in enumerate(odd)] * 2, "doc_id long, text string, ids string, decoded string")
    path = P.path("piece_bpe_32k.model")
    got = decode(encode(df, path), path).collect()
    assert sorted((r["doc_id"], r["decoded"] is None, r["decoded"] or "") for r in got) == sorted((i, t is None, t or "") for i, t in enumerate(odd) for _ in range(2))
    assert encode(df.limit(0), path).count() == 0
    assert vocabulary.encode("a b") != vocabulary.encode("a▁b")
