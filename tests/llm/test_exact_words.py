"""Words that structured hashes take for equal, and near copies against plain sets."""

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import minhash, packing, words

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def thue_morse(n, a="a", b="b"):
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


PAIRS = [thue_morse(n, *ends) for n in (10, 11, 12) for ends in (("a", "b"), ("ab", "cd"), ("x", "é"))]


def test_hashes_tell_structured_words_apart():
    texts = [w for pair in PAIRS for w in pair] + ["a\x00", "a", "a\x00\x00", "abcdefgh", "abcdefgh\x00"]
    w = words.words(pa.array(texts))
    assert len(set(w.hash.tolist())) == len(texts) and len(set(words.word_numbers(w).tolist())) == len(texts)


def test_equal_hashes_of_different_words_are_numbered_apart():
    w = words.words(pa.array(["one two one three", "two four one"]))
    w.hash = w.hash % words.U64(1)
    number = words.word_numbers(w).tolist()
    assert [number[0] == n for n in number] == [True, False, True, False, False, False, True] and number[1] == number[4] and len(set(number)) == 4


def test_packing_has_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    texts = [w for pair in PAIRS for w in pair] + [f"{a} {b} {a}" for a, b in PAIRS] + ["same row"] * 3 + [None, "", "x " * 9000, "İ ǰ Σσς <|endoftext|> a<|endoftext|>b　c"]
    rows = [(None if i % 5 == 0 else i % 7, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(3)
    want = sorted((-1 if i is None else i, *((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) if (ids := [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) else ())) for i, t, _ in rows)
    got = packing.pack(df, PATH, 2, 1 << 20, ids=True).collect()
    whole = [r for r in got if r["start"] == 0 and r["length"] == r["doc_tokens"]]
    assert len(got) == len(whole) == len(rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["length"], r["ids_crc32"]) for r in whole) == want
    assert sorted(r["offset"] + k for r in got for k in range(r["length"])) == list(range(sum(n for _, n, _ in want)))


def test_tokenizer_memory_compares_bytes(monkeypatch):
    from tokenizers import Tokenizer

    def crowded(texts, lower=False):
        w = words.words(texts, lower)
        w.hash = w.hash % words.U64(11)
        return w

    monkeypatch.setattr(packing, "words", crowded)
    tokenizer, memory = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    texts = [" ".join(f"word{i * j % 40}" for i in range(30)) for j in range(20)]
    for _ in range(2):
        ids, sizes = memory.encode(pa.array(texts), None)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def linked(rows, percent, size):
    """(id, number of shingles, component) by plain sets of tuples and a union of all pairs."""
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    return sorted((i, len(sets[i]), group[i], group[i] == i) for i in sets)


def near(df, percent, size, **options):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, percent, size, **options).collect())


def test_structured_words_are_no_copies(spark):
    rows = list(enumerate([w for pair in PAIRS for w in pair] + [f"{a} {b}" for a, b in PAIRS] + [f"{b} {a}" for a, b in PAIRS] + ["A b", "a B", "b a", "a b c", "c"]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(df, 85, 3) == linked(rows, 85, 3)


@pytest.mark.parametrize("block", [4, 512])
def test_groups_at_the_threshold(spark, block):
    """Copies with a few words changed, so that many pairs lie just above or below the threshold; fields of many blocks."""
    rng = np.random.default_rng(7)
    rows = []
    for base in range(4):
        text = [f"b{base}w{i}" for i in range(60)]
        for n in range(30):
            copy = list(text)
            for at in rng.choice(60, rng.integers(0, 5), replace=False):
                copy[at] = f"n{base}x{n}x{at}" if n % 2 else f"y{at}"
            rows.append((base * 100 + n, " ".join(copy)))
    rows += [(900 + i, rows[0][1].upper()) for i in range(3)] + [(950, None), (951, " \t"), (952, "short text"), (953, "Short text")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, digest string, id string").repartition(5)
    assert near(df, 85, 3, block=block) == linked(rows, 85, 3)


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for share in (0.2, 0.5, 0.85, 0.95):
        for _ in range(20):
            both = rng.integers(0, 1 << 63, 400, dtype=np.int64).astype(words.U64)
            n = int(400 * share)
            a, b = (np.sort(np.concatenate((both[:n], rng.integers(0, 1 << 63, (400 - n) // 2, dtype=np.int64).astype(words.U64)))) for _ in range(2))
            sigs = [minhash.pack(minhash.minima(x, np.array([0, len(x)]))) for x in (a, b)]
            errors.append(minhash.estimated(*sigs)[0] - n / (len(a) + len(b) - n))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.2
