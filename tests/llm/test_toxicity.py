"""The factorization machine against brute force, on an interaction, and on the given labels."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import q05_toxicity, toxicity
from millrace.llm.common import read_table


def made(n, rule, seed, share=0.3):
    """Texts' terms with two marked ones (1 and 2), each in that share of the texts, and the labels that ``rule`` gives."""
    rng = np.random.default_rng(seed)
    a, b = rng.random(n) < share, rng.random(n) < share
    rows = [sorted({*rng.integers(100, 500, 20).tolist(), *([1] if x else []), *([2] if z else [])}) for x, z in zip(a, b, strict=True)]
    return np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows), rule(a, b).astype(float)


def right(machine, doc, term, y):
    return ((machine.margins(doc, term, len(y)) > 0) == (y > 0)).mean()


@pytest.mark.parametrize("rule", [np.logical_xor, np.logical_and, lambda a, b: a & ~b])
def test_pairs_of_terms_are_learnt(rule):
    machine = toxicity.fit(*made(2000, rule, 0), 1 << 13)
    assert right(machine, *made(2000, rule, 1)) > 0.99 and {1, 2} <= set(machine.chosen.tolist())


def test_additive_weights_do_not_learn_what_the_machine_does():
    here, there = made(2000, np.logical_xor, 0, 0.45), made(2000, np.logical_xor, 1, 0.45)
    additive = toxicity.fit(*here, 1 << 13, factors=0)
    assert right(additive, *there) < 0.85 and right(toxicity.fit(*here, 1 << 13), *there) > 0.99


def test_margins_equal_the_sum_over_all_pairs():
    rng = np.random.default_rng(2)
    machine = toxicity.Machine(np.arange(10, 30), -1.0, rng.normal(size=20), rng.normal(size=(20, 8)))
    texts = [sorted(rng.choice(np.arange(5, 35), n, replace=False).tolist()) for n in (0, 1, 5, 12)]
    got = machine.margins(np.repeat(np.arange(4), [len(t) for t in texts]), np.concatenate(texts).astype(int), 4)
    for t, z in zip(texts, got, strict=True):
        known = [x - 10 for x in t if 10 <= x < 30]
        pairs = sum(machine.v[a] @ machine.v[b] for n, a in enumerate(known) for b in known[:n])
        assert z == pytest.approx(-1.0 + machine.w[known].sum() + pairs)


def test_held_out_rows_of_the_given_table(spark):
    rows = q05_toxicity.query(spark, "/root/testdata/sf0.1").collect()
    labels = {r["doc_id"]: r["toxic"] for r in read_table(spark, "/root/testdata/sf0.1", "labels").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    known = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    caught = sum(p and y for p, y in known)
    assert caught / sum(y for _, y in known) > 0.85 and caught / sum(p for p, _ in known) > 0.9


def test_repeated_rows_long_texts_and_ties(spark):
    rows = [(i % 200, ("idiot " if i % 200 < 40 else "") + f"plain words {i % 7}") for i in range(400)] + [(300, "word " * 200_000), (None, "idiot"), (300, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(200)] * 2 + [(5, 0), (999, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels, most_rows=100)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows) and toxicity.score(df.limit(0), model).count() == 0
    by_text = {}
    for r in got:
        by_text.setdefault(r["text"], set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    assert toxicity.Machine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, 8))).scores(pa.array(["a", ""])).tolist() == [0.5, 0.5]
