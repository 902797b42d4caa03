"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct runs of letters in lower case and their first 4, 5
and 6 bytes, which stand for the stem of an inflected word. The score is
sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>): the pairs learn what two terms say
together that neither says alone. The sum over pairs is taken in linear time as
half of |sum v|^2 - sum |v|^2.

Terms reach the machine by what they tell alone (chi-square of their counts in both
labels) or by what they tell in a pair: among the ``pool`` most frequent terms, those
whose share of label 1 in a pair departs from the sum of the single effects. An insult
that is harmless without a group's mention, and a mention that is harmless without an
insult, are found so, although neither has a count of its own to show.

The model is fitted in one task on a bounded sample of labelled rows
(``most_rows``, those with the least hash of their id) and has a fixed size. All else
runs over all documents in parallel.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .words import _LOWER, U64, eights, run_hash, slices, text_bytes

TABLE_BITS = 20
FACTORS = 8
#: Least chi-square (one degree) of a term's counts in both labels, and of a pair's departure from the sum of its terms' effects.
LEAST_CHI, LEAST_PAIR = 20.0, 60.0
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) of the distinct hashed terms, in order of the document."""
    data, at = text_bytes(texts)
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _LETTER[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:n]))
    last = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    lower = _LOWER[data]
    wide = eights(lower)
    doc = np.searchsorted(at, first, "right") - 1
    docs, found = [], []
    for kind in (0, 4, 5, 6):
        sel = np.flatnonzero(last - first > kind)
        end = last[sel] if kind == 0 else first[sel] + kind
        h = run_hash(lower, wide, first[sel], end, kind)
        docs.append(doc[sel])
        found.append(h >> U64(64 - TABLE_BITS))
    both = np.unique((np.concatenate(docs).astype(U64) << U64(TABLE_BITS)) | np.concatenate(found))
    return (both >> U64(TABLE_BITS)).astype(np.int64), (both & U64((1 << TABLE_BITS) - 1)).astype(np.int64)


class Machine:
    """w0, and for each chosen term a weight and a vector; other terms count nothing."""

    def __init__(self, chosen: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.chosen, self.w0, self.w, self.v = chosen, w0, w, v

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, chosen=self.chosen, w0=self.w0, w=self.w, v=self.v)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Machine:
        x = np.load(io.BytesIO(data))
        return cls(x["chosen"], float(x["w0"]), x["w"], x["v"])

    def margins(self, doc: np.ndarray, term: np.ndarray, n_docs: int) -> np.ndarray:
        place = np.full(1 << TABLE_BITS, -1, np.int64)
        place[self.chosen] = np.arange(len(self.chosen))
        term = place[term]
        doc, term = doc[term >= 0], term[term >= 0]
        out = np.full(n_docs, self.w0)
        out += np.bincount(doc, self.w[term], n_docs)
        for v in self.v.T:
            s, q = np.bincount(doc, v[term], n_docs), np.bincount(doc, v[term] ** 2, n_docs)
            out += (s * s - q) / 2
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = [1 / (1 + np.exp(-np.clip(self.margins(*terms(texts[i:j]), j - i), -30, 30))) for i, j in slices(texts)]
        return np.concatenate(out) if out else np.zeros(0)


def telling(doc: np.ndarray, term: np.ndarray, y: np.ndarray, most: int, least: float, rows: int = 4) -> np.ndarray:
    """Terms in ``rows`` texts or more whose counts in both labels differ by a chi-square of ``least`` or more."""
    n, positive = len(y), y.sum()
    df = np.bincount(term, minlength=1 << TABLE_BITS).astype(float)
    hit = np.bincount(term, y[doc], minlength=1 << TABLE_BITS)
    expect = df * positive / n
    chi = np.where(df >= rows, (hit - expect) ** 2 / np.maximum(expect * (1 - df / n), 1e-9), 0)
    chosen = np.argsort(-chi, kind="stable")[:most]
    return chosen[chi[chosen] >= least]


def interacting(doc: np.ndarray, term: np.ndarray, y: np.ndarray, pool: int, least: float, share: float = 0.5, expected: float = 5.0) -> np.ndarray:
    """Frequent terms that tell something in a pair beyond the sum of what both tell alone.

    The share of label 1 is taken with both terms, either and none; its contrast p11 - p10 -
    p01 + p00 is held against its variance. A cell counts with ``expected`` rows of either label or more;
    terms in more than ``share`` of the texts are left out.
    """
    n, p = len(y), y.mean()
    need = expected / (p * (1 - p))
    df = np.bincount(term, minlength=1 << TABLE_BITS)
    common = np.argsort(-np.where(df <= share * n, df, 0), kind="stable")[:pool]
    common = common[(df[common] >= need) & (df[common] <= share * n)]
    if len(common) < 2:
        return common[:0]
    place = np.full(1 << TABLE_BITS, -1, np.int64)
    place[common] = np.arange(len(common))
    term = place[term]
    doc, term = doc[term >= 0], term[term >= 0]
    both = np.zeros((len(common), len(common)), np.float32)
    hit = both.copy()
    for i in range(0, n, 4096):
        part = slice(*np.searchsorted(doc, (i, i + 4096)))
        m = np.zeros((min(4096, n - i), len(common)), np.float32)
        m[doc[part] - i, term[part]] = 1
        both += m.T @ m
        m = m[y[i : i + 4096] > 0]
        hit += m.T @ m
    both, hit = both.astype(float), hit.astype(float)
    one, one_hit = np.diag(both), np.diag(hit)
    a, b, ah, bh = one[:, None], one[None, :], one_hit[:, None], one_hit[None, :]
    contrast, variance, good = 0.0, 0.0, ~np.eye(len(common), dtype=bool)
    for sign, count, positive in ((1, both, hit), (-1, a - both, ah - hit), (-1, b - both, bh - hit), (1, n - a - b + both, y.sum() - ah - bh + hit)):
        good &= count >= need
        contrast = contrast + sign * positive / np.maximum(count, 1)
        variance = variance + 1 / np.maximum(count, 1)
    return common[np.where(good, contrast**2 / (p * (1 - p) * variance), 0).max(1) >= least]


def fit(
    doc: np.ndarray, term: np.ndarray, y: np.ndarray, most_terms: int, least_chi: float = LEAST_CHI, least_pair: float = LEAST_PAIR, pool: int = 2048, epochs: int = 60, rate: float = 0.05, decay: float = 1e-3, factors: int = FACTORS
) -> Machine:
    """Adagrad on the logistic loss over the terms that tell something alone or in a pair; no ``factors``: additive weights."""
    n, positive = len(y), float(y.sum())
    w0 = float(np.log((positive + 1) / (n - positive + 1))) if n else 0.0
    if not n or positive in (0, n):
        return Machine(np.zeros(0, np.int64), w0, np.zeros(0), np.zeros((0, factors)))
    chosen = np.union1d(telling(doc, term, y, most_terms, least_chi), interacting(doc, term, y, pool, least_pair))
    place = np.full(1 << TABLE_BITS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    term = place[term]
    doc, term = doc[term >= 0], term[term >= 0]
    bounds = np.searchsorted(doc, np.arange(n + 1))
    rng = np.random.default_rng(7)
    w, v = np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), factors))
    gw, gv, g0 = np.full(len(w), 1e-8), np.full(v.shape, 1e-8), 1e-8
    batches = []
    for part in np.array_split(rng.permutation(n), max(1, n // 128)):
        size = bounds[part + 1] - bounds[part]
        row = np.repeat(np.arange(len(part)), size)
        t = term[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(bounds[part], size)]
        by_term = np.argsort(t, kind="stable")
        full = np.flatnonzero(size)
        batches.append((y[part], row, t, by_term, *np.unique(t[by_term], return_index=True), full, (np.cumsum(size) - size)[full]))
    for _ in range(epochs):
        for number in rng.permutation(len(batches)):
            want, row, t, by_term, held, first, full, begin = batches[number]
            z, s = np.full(len(want), w0), np.zeros((len(want), factors))
            if len(t):
                vt = v[t]
                s[full] = np.add.reduceat(vt, begin, axis=0)
                z[full] += np.add.reduceat(w[t], begin) + ((s[full] ** 2).sum(1) - np.add.reduceat((vt**2).sum(1), begin)) / 2
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - want) / len(want)
            g0 += e.sum() ** 2
            w0 -= rate * e.sum() / g0**0.5
            if len(t):
                dw = np.add.reduceat(e[row][by_term], first) + decay * w[held] / n
                dv = np.add.reduceat((e[row, None] * (s[row] - vt))[by_term], first, axis=0) + decay * v[held] / n
                gw[held] += dw**2
                gv[held] += dv**2
                w[held] -= rate * dw / np.sqrt(gw[held])
                v[held] -= rate * dv / np.sqrt(gv[held])
    return Machine(chosen, w0, w, v)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, most_terms: int = 1 << 13, least_chi: float = LEAST_CHI, least_pair: float = LEAST_PAIR) -> bytes:
    """A machine fitted on at most ``most_rows`` labelled documents outside the held-out fold.

    ``most_terms`` bounds the terms chosen for themselves; ``least_chi`` and ``least_pair`` say how much a term
    must tell alone or in a pair. A document with labels of both kinds counts as toxic; of rows that share an
    id the least text stands for it; labels without a document, and null ids, teach nothing.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)

    def extract(batches):
        for batch in batches:
            for i, j in slices(batch.column(1)):
                doc, term = terms(batch.column(1)[i:j])
                at = np.searchsorted(doc, np.arange(j - i + 1))
                found = [term[x:y].astype(np.int32).tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([0] * (j - i)), batch.column(0)[i:j], batch.column(2)[i:j], pa.array(found, pa.binary())], ["one", "doc_id", "toxic", "terms"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("terms", "ascending")])
        found = [np.frombuffer(x, np.int32) for x in table["terms"].to_pylist()]
        doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
        machine = fit(doc, np.concatenate(found).astype(np.int64), table["toxic"].to_numpy().astype(float), most_terms, least_chi, least_pair)
        return pa.table({"model": pa.array([machine.to_bytes()], pa.binary())})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # one row an id, so the bound holds
    features = rows.select("doc_id", "text", F.col("toxic").cast("int")).mapInArrow(extract, "one long, doc_id long, toxic int, terms binary")
    model = features.groupBy("one").applyInArrow(learn, "model binary").first()
    return bytes(model["model"]) if model else Machine(np.zeros(0, np.int64), -2.0, np.zeros(0), np.zeros((0, FACTORS))).to_bytes()


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """Adds ``score`` (0 to 1, higher: toxic likelier) to all columns of ``docs``.

    A null text is scored as an empty one, which has the score of no term at all.
    All rows are kept, repeated ones too. Without labels of both kinds the
    machine knows no term and all rows score alike.
    """
    docs = docs.drop("score")
    names, whole = docs.columns, docs.sparkSession.sparkContext.broadcast(model)
    at = names.index("text")

    def scan(batches):
        machine = Machine.from_bytes(whole.value)
        for batch in batches:
            scores = pa.array(machine.scores(batch.column(at)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*names, "score"])

    return docs.mapInArrow(scan, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
