"""op12 against loops over documents and orders."""

import re
from collections import defaultdict
from itertools import permutations

import pytest

from millrace.llm import filter_audit

many = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, many, "a"), (2, many, "a"), (3, many, None), (4, None, ""), (5, "", "b"), (6, "ABC def", "a"), (7, "x # y", "b"), (8, "w " * 80, "b"), (9, "W " * 80 + "|", "b"),
    (10, many.upper(), "a"), (11, "É" * 60, "c"), (None, many, "a"), (None, many, "c"), (3, many, "b"), (12, "x" * 200_000 + " Y", "c"), (2, many, "a"), (1, many, "c"), (13, many + " X\x1fY\x0b$", "c"), (14, None, "c"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (6, 1, 1), (9, None, 1), (99, 1, 1), (None, 1, 1), (13, 0, 0)]


def brute(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    found = defaultdict(list)
    for doc, text, source in rows:
        x = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", x)) > 5 * len(x), "D": bool(re.search(r"[#$%&*|]", x)),
            "E": doc is not None and any(d is not None and d < doc and (t or "") == x for d, t, _ in rows),
        }
        found[source or ""].append((doc, {k for k, v in fails.items() if v}))
    out = {}
    for part, docs in found.items():
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[1]]
                gone = [x for x in docs if f in x[1] and x not in left]
                total = sum(f in x[1] for x in docs)
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(here)
                out[part, "".join(order), step] = [
                    len(left), len(here), total - len(here), sum(x[1] == {f} for x in docs), sum(x[0] in good for x in here if x[0] is not None), sum(x[0] in toxic for x in here if x[0] is not None)
                ]
                assert len(gone) <= total
        for (p, o, s), row in out.items():
            if p == part:
                row.append(shapley[o[s - 1]])
    return out


def test_audit(spark):
    docs = spark.createDataFrame([(*r, 1, "q") for r in ROWS], "doc_id long, text string, source string, mask int, digest string").repartition(3)
    labels = spark.createDataFrame([(*r, "z") for r in LABELS], "doc_id long, quality int, toxic int, part string")
    found = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.filter_audit(docs, labels).collect()}
    assert found == brute(ROWS, LABELS)


def test_empty(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs, labels).count() == 0
    one = filter_audit.filter_audit(spark.createDataFrame([(1, many, "s")], docs.schema), labels)
    assert one.count() == 600 and one.where("removed + redundant + shapley > 0 or kept <> 1").count() == 0


@pytest.mark.parametrize("n", [1, 3, 5])
def test_intervals(n):
    every = filter_audit.orders("ABCDE"[:n])
    for mask in range(1 << n):
        want = {(next(s for s, f in enumerate(o, 1) if mask >> ord(f) - 65 & 1), r) for r, o in enumerate(every)} if mask else set()
        found = [(s, r) for s, first, end in filter_audit.intervals(mask, n) for r in range(first, end)]
        assert sorted(found) == sorted(want)
    assert all(filter_audit.rank(tuple(ord(f) - 65 for f in o), n) == r for r, o in enumerate(every))
