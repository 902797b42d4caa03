"""Vector searches against brute force: repeated ids, ties, several shards, and the forest's recall and work."""

from collections import Counter

import numpy as np
import pytest

from millrace.llm import knn_exact, knn_forest
from millrace.llm.common import read_table
from millrace.llm.knn_exact import exact_top_k
from millrace.llm.knn_forest import approximate_top_k


def answers(rows, every, k, score):
    """(query_id, rank, vec_id, score) of every query row, as a multiset."""
    out = Counter()
    for n, (qid, q) in enumerate(rows):
        if qid % every == 0:
            found = sorted((-score(q, v), i) for m, (i, v) in enumerate(rows) if m != n)[:k]
            out.update((qid, r, i, -s) for r, (s, i) in enumerate(found, 1))
    return out


def whole(q, v):
    return int(np.floor(1024 * np.array(q)) @ np.floor(1024 * np.array(v)))


@pytest.mark.parametrize("shard_bytes", [1 << 25, 4096])
def test_exact_search_with_repeated_ids_and_ties(spark, shard_bytes):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 6)).round(2)
    rows = [(i // 2 if i < 40 else i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [rows[0], rows[0], (100, rows[3][1])] + [(400 + i, [1.0] * 6) for i in range(30)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows] + [(200, None, "x", "y"), (None, [1.0] * 6, "x", "y"), (100, [float("nan")] * 6, "", ""), (300, [1.0, 2.0], "", "")], "vec_id long, embedding array<double>, shard string, _id string")
    got = Counter(map(tuple, exact_top_k(df, 20, 10, shard_bytes=shard_bytes).collect()))
    assert got == answers(rows, 20, 10, whole)
    assert exact_top_k(df.limit(0), 20).count() == 0


def test_forest_with_repeated_ids_finds_all_of_a_small_table(spark):
    rng = np.random.default_rng(2)
    rows = [(i // 2, v.tolist()) for i, v in enumerate(rng.normal(size=(150, 6)).round(2))]
    rows += [rows[0], (20, [1.0] * 6), (21, [1.0] * 6), (22, [1.0] * 6)]
    df = spark.createDataFrame(rows + [(40, [0.0] * 6), (60, None)], "vec_id long, embedding array<double>")
    got = Counter((q, r, i, round(s, 9)) for q, r, i, s in approximate_top_k(df, 20, 10, spread=200).collect())
    assert got == Counter({(q, r, i, round(s, 9)): n for (q, r, i, s), n in answers(rows, 20, 10, lambda a, b: float(np.dot(a, b))).items()})
    assert approximate_top_k(df.limit(0), 20).count() == 0
    assert approximate_top_k(df.limit(1), 20).count() == 0


def test_forest_ranks_a_tenth_of_the_rows_and_finds_nine_tenths_of_the_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    queries = np.arange(0, len(x), 200)
    scores = x[queries] @ x.T
    scores[np.arange(len(queries)), queries] = -np.inf
    nearest = np.argsort(-scores, axis=1)[:, :20]
    f = knn_forest.forest(x, 64, 48)
    gains = knn_forest.cosines(f, x, 0.2)
    ranked = [knn_forest.candidates(f, w, np.ones(len(x)), gains, 0.2, len(x) // 10) for w in knn_forest.far_sides(f, x[queries])]
    assert max(map(len, ranked)) == len(x) // 10
    assert np.mean([len(np.intersect1d(a, b)) / 20 for a, b in zip(ranked, nearest, strict=True)]) > 0.95
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.astype(np.float32).tolist())], "vec_id long, embedding array<float>")
    found = {}
    for r in approximate_top_k(df, 200, 20).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(found[q] & set(b)) / 20 for q, b in zip(queries.tolist(), nearest.tolist(), strict=True)]) > 0.95


def recall(spark, x, every, **options):
    """The whole query's recall against brute force; each answer is as long as it has to be."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)
    found, right = approximate_top_k(df, every, 20, **options).collect(), 0
    queries = range(0, len(x), every)
    assert len(found) == 20 * len(queries)
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        right += len({r["vec_id"] for r in found if r["query_id"] == q} & set(np.argsort(-s)[:20].tolist()))
    return right / len(found)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_forest_recall_on_the_given_tables(spark, sf):
    rows = sorted((r["vec_id"], r["embedding"]) for r in read_table(spark, f"/root/testdata/{sf}", "embeddings").collect())
    assert recall(spark, np.array([v for _, v in rows], float), 20) >= 0.95


@pytest.mark.parametrize("sigma", [0.5, 1.0])
def test_forest_recall_where_norms_differ(spark, sigma):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 64)) * np.exp(sigma * rng.normal(size=(20_000, 1)))
    assert recall(spark, x, 400) >= 0.95
    assert recall(spark, x[:6000], 400, shard_bytes=1 << 20) >= 0.95


def test_forest_recall_where_all_vectors_lean_one_way(spark):
    rng = np.random.default_rng(7)
    assert recall(spark, rng.normal(size=(10_000, 64)) + 3 * rng.normal(size=(1, 64)), 200) >= 0.95


def test_copies_of_one_vector_do_not_make_a_large_leaf():
    x = np.concatenate((np.ones((5000, 8)), np.random.default_rng(4).normal(size=(1000, 8))))
    f = knn_forest.forest(x, 4, 64)
    assert f["leaves"].shape[1] <= 64 and all(sorted(r[r >= 0]) == list(range(6000)) for r in f["leaves"].reshape(4, -1))


def test_kth_score_prunes_leaves():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(1000, 3)) * 0.1 + c for c in rng.normal(size=(20, 3)) * 10])
    tree = knn_exact.kd_tree(x, 64)
    tree |= {"x": x[tree["order"]], "ids": tree["order"]}
    q = x[:1]
    looked: list[int] = []
    ids, scores = knn_exact.best(tree, q[0], knn_exact.bounds(tree, q)[0], -np.inf, 0, 10, looked)
    want = np.argsort(-(x @ q[0]), kind="stable")
    assert set(ids) == set(want[want != 0][:10]) and len(looked) < 20
    again: list[int] = []
    knn_exact.best(tree, q[0], knn_exact.bounds(tree, q)[0], scores[-1], 0, 10, again)
    assert len(again) <= len(looked)
