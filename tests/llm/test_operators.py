"""Small cases and edge cases of the ten operators, against plain loops."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import minhash, packing, pii, sharding, substring_dedup, toxicity, warc
from millrace.llm.components import components
from millrace.llm.knn_exact import exact_top_k
from millrace.llm.knn_forest import approximate_top_k
from millrace.llm.sentencepiece_viterbi import Vocabulary, digest

P = pytest.importorskip("public_tokenizers")
passage = " ".join(f"w{i}" for i in range(60))
TEXTS = [passage, "x " + passage + " y", None, "", "a a a a " * 30, "short", passage + " tail", passage, "é\tmixed\nwhite  space " + " ".join(f"q{i}" for i in range(30)), "long " * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "n", "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n string, chunk string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_substring(docs, empty):
    seen, want = set(), {}
    for i, t in enumerate(TEXTS):
        w, cover = re.findall(r"[^\x20\x09-\x0D]+", t or ""), set()
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                cover.update(range(k, k + 20))
            seen.add(g)
        kept = " ".join(x for k, x in enumerate(w) if k not in cover)
        want[i] = (len(w), len(cover), hashlib.sha256(kept.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == want
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert set(substring_dedup.remove_repeats(docs, texts=True).columns) >= {"kept_text", "n", "chunk"}


def test_pii(spark):
    texts = ["mail a@b.co, ip 1.2.3.4 or 1.2.3.400", "card 4111 1111 1111 1111 phone +1 (555) 123-4567", "iban GB82 WEST 1234 5698 7654 32", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["spans"] for r in pii.digest(df).orderBy("doc_id").collect()]
    assert got == ["email:5:11,ip:16:23", "card:5:24,phone:31:48", "iban:5:32", "", ""]
    masked = [r["text"] for r in pii.masked(df).orderBy("doc_id").collect()]
    assert masked == ["mail <EMAIL>, ip <IP> or 1.2.3.400", "card <CARD> phone <PHONE>", "iban <IBAN>", None, ""]


def test_pii_base_kinds_against_plain_patterns(spark):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def good(kind, found):
        number = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(x) <= 255 for x in found.split("."))
        if kind == "card":
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
            return 12 <= len(number) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
        return kind == "email" or 9 <= len(number) <= 15

    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list(letters), 120)) for letters in ("a1.@-", "0123456789 -", "+1() .-29", "12.", "a.@+\u00e9\U0001f600 1\n", "0 -+@.a") for _ in range(150)]
    texts += ["1" * 50000, "a." * 4000 + "@", "1." * 5000, "+1" * 20000, "@a." * 20000, "4111 1111 1111 1111 " * 2000, "\u0661" * 16, "0001.002.03.255"]
    want = {}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(kinds.items()) for m in re.finditer(p, t) if good(k, m.group()))
        want[i] = hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, e, k in spans).encode()).hexdigest()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["base_sha256"] for r in pii.digest(df).collect()}
    assert [i for i in want if got[i] != want[i]] == []


def test_sentencepiece(docs):
    v = Vocabulary(P.path("piece_bpe_32k.model"))
    text = "▁the▁antireti▁ö☃x"
    best = [0.0] + [-1e18] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - v.longest), j):
            node = v.trie
            for ch in text[i:j]:
                node = node.get(ch, {}) if node else node
            s = node[""][1] if node and "" in node else v.unknown_score if j - i == 1 else -1e18
            best[j] = max(best[j], best[i] + s)
    score = {i: n[1] for n in _leaves(v.trie) for i in [n[0]]}
    ids = [i for part in v.stream(text) for i in part]
    known = sum(score.get(i, 0) for i in ids)
    n_unknown = sum(1 for ch in text if ch not in v.trie or "" not in v.trie[ch])
    assert abs(known + n_unknown * v.unknown_score - best[-1]) < 1e-6
    assert v.decode(np.frombuffer(v.encode("the antireti  ö☃x "), "<u4")) == "the antireti  ö☃x "
    assert all(r["round_trip"] for r in digest(docs, P.path("piece_bpe_32k.model")).collect())


def _leaves(node):
    for k, x in node.items():
        if k == "":
            yield x
        else:
            yield from _leaves(x)


def test_near_duplicates(spark, docs, empty):
    got = {r["doc_id"]: (r["component_id"], r["kept"], r["n_shingles"]) for r in minhash.near_duplicates(docs, 85, 3).collect()}
    assert got[0] == (0, True, 58) and got[1][0] == 0 and got[6][0] == 0 and got[7] == (0, False, 58)
    assert got[2] == (2, True, 0) and got[3] == (3, True, 0) and got[5] == (5, True, 1) and len(got) == len(TEXTS)
    assert minhash.near_duplicates(empty).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 100)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_toxicity(spark):
    rows = [(i, f"plain words {i % 7} here" + (" idiot you" if i % 4 == 0 else "")) for i in range(400)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, toxicity.train(df, labels)).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(400)) and got[1000] == got[1001]
    assert len({r["score"] for r in toxicity.score(df, toxicity.train(df, labels.limit(0))).collect()}) == 1


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = packing.pack(docs, P.path("word_bpe_49k.json"), 2, 64).collect()
    for r in rows:
        ids = [*t.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    total = sum(r["length"] for r in rows)
    assert sorted(r["sequence_id"] * 64 + r["offset"] + k for r in rows for k in range(r["length"])) == list(range(total))
    assert packing.pack(empty, P.path("word_bpe_49k.json"), 2).count() == 0


def test_vector_searches(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).round(3)
    x[7] = x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [float("nan")] * 8), (302, [None] * 8), (303, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = np.floor(x * 1024)
    scores = whole[::100] @ whole.T
    for q, s in zip((0, 100, 200), scores, strict=True):
        best = sorted((-v, i) for i, v in enumerate(s) if i != q)[:10]
        zero = [r for r in exact_top_k(df, 100).where(F.col("query_id") == q).orderBy("rank").collect() if r["vec_id"] != 303]
        assert [(-r["score"], r["vec_id"]) for r in zero] == best[: len(zero)]
    near = approximate_top_k(df, 20, 20)
    assert near.count() == 15 * 20 and near.where("vec_id >= 300").count() == 0
    assert exact_top_k(df.limit(0), 100).count() == 0


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(3, "u", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "v", None), (5, "w", ""), (9, "x", "y" * 100000)], "page_id long, url string, html string")
    folder = tmp_path.as_uri()
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(warc.write(pages, folder, file_bytes=64), folder).collect()}
    assert got == {1: (9, "response", None), 3: (9, "revisit", 1), 2: (0, "response", None), 5: (0, "revisit", 2), 9: (100000, "response", None)}


def test_sharding(docs, empty):
    rows = sharding.shard(docs, shards=3).collect()
    assert len(rows) == len(TEXTS)
    by_text = {}
    for r in rows:
        by_text.setdefault(TEXTS[r["doc_id"]] or "", set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(empty, shards=3).count() == 0
    assert sharding.smallest_capacity([4, 4, 4, 4], 2) == 8 and sharding.cut_points([4, 4, 4, 4], 2) == [2]


def test_warc_shards_of_scattered_ids(spark, tmp_path):
    ids = [-(2**63), -5, *range(200), 2**40, 2**40 + 1, 2**63 - 1]
    pages = spark.createDataFrame([(i, None, f"{i % 90}" * 400) for i in ids], "page_id long, url string, html string")
    first = {}
    for i in ids:
        first.setdefault(i % 90, i)
    written = []
    for name in ("one", "two"):
        folder = (tmp_path / name).as_uri()
        manifest = warc.write(pages, folder, shard_bytes=1 << 14, bits=4)
        written.append(sorted(map(tuple, manifest.collect())))
        got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(manifest, folder).collect()}
        assert got == {i: (400 * len(str(i % 90)), *(("response", None) if first[i % 90] == i else ("revisit", first[i % 90]))) for i in ids}
    assert written[0] == written[1] and len(written[0]) > 10 and max(r[2] for r in written[0]) < 40
    empty = (tmp_path / "none").as_uri()
    assert warc.read(warc.write(pages.limit(0), empty), empty).count() == 0
