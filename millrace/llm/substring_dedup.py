"""Removal of repeated passages by relative Lempel-Ziv parsing.

The corpus is cut into reference blocks (documents by a hash of their id). Documents are
factored greedily against the blocks: a factor is the longest run of words from here on
that a block holds at an earlier place. Factors of ``window`` words and more become
duplicate spans. After a factor the parse goes on with the first window that is not
wholly inside it, so windows across a factor's boundary are looked up as well, and
neighbouring factors may overlap there.

A document is parsed only against blocks that can yield such a factor, and only where
they can. Three rounds of messages between blocks find out which:

1. Each block sends the winnowing minima of its windows (the least hash of the
   ``phrase``-word grams inside a window, about one for 8 words), each once. A
   minimum that no other place has rules out all its windows.
2. For the remaining windows, each block sends a 96-bit hash of the window and
   the smallest id of a document in the block that holds it, each window once. Back
   comes the block with the earliest place, where that is another one.
3. Runs of windows whose earliest places lie in the same block are segments. Their words are
   sent to that block, equal ones once. It indexes its windows, parses each segment against its
   own words, and answers with the factors.

In the parse words count as equal only if their bytes are, so what is removed is
there at an earlier place, whatever the hashes. All rounds are pre-aggregated by block and, for
segments, across blocks, so a passage shared by a third of all documents adds one entry a block.
Blocks and hash ranges grow with the volume, up to 16 times, so that messages stay
packed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_for, shuffle_partitions, text_volume
from .words import U64, Words, grams, mix, same, sliding_min, slices, words

LEAST_ID = -(2**63)
#: Answers to a block. Kinds 1 and 2: bits in the order of what was sent to the bucket, and for 2 the blocks of the set bits.
#: Kind 3: the block that parsed, a segment's digest, and its factors.
_ANSWER = "chunk long, kind int, bucket int, bits binary, more binary"
#: A window that occurs often in a block is extended at so many of its places; the longest extension is taken.
PLACES = 64


def _unpack(blob, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


class _Block:
    """The windows of one block's documents, in order of (doc_id, text)."""

    def __init__(self, table: pa.Table, window: int, phrase: int, whole: bool):
        order = table.select(["_id", "_text"]).append_column("_row", pa.array(np.arange(table.num_rows)))
        order = order.sort_by([("_id", "ascending"), ("_text", "ascending")]).combine_chunks()
        self.rows = order["_row"].to_numpy()
        self.ids = order["_id"].to_numpy()
        self.texts = order["_text"].chunk(0)
        self.n_words = np.zeros(len(self.ids), np.int64)
        width = window - phrase + 1
        pad = np.zeros(width - 1, U64)
        doc, start, low, chosen, a, b = [], [], [], [], [], []
        for i, j in slices(self.texts):
            w = words(self.texts[i:j])
            count = w.per_doc()
            self.n_words[i:j] = count
            n = len(w.hash) - window + 1
            if n < 1:
                continue
            good = w.doc[:n] == w.doc[window - 1 :]
            g = grams(w, phrase)
            least = sliding_min(g, width)
            # a gram is chosen where it is the least one of some window that holds it
            most = ~sliding_min(~np.concatenate((pad, np.where(good, least, U64(0)), pad)), width)
            chosen.append(g[g == most])
            good = np.flatnonzero(good)
            low.append(least[good])
            if whole:
                base = np.concatenate(([0], np.cumsum(count)))[:-1]
                doc.append(w.doc[good] + i)
                start.append(good - base[w.doc[good]])
                a.append(grams(w, window, 1)[good])
                b.append(grams(w, window, 2)[good].astype(np.uint32))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.low = join(low, U64)
        self.chosen, self.times = np.unique(join(chosen, U64), return_counts=True)
        if whole:
            self.doc, self.start = join(doc, np.int64), join(start, np.int64)
            self.a, self.b = join(a, U64), join(b, np.uint32)

    def minima(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct minima in order of (bucket, value), and their buckets."""
        bucket = (mix(self.chosen ^ U64(0x5851F42D4C957F2D)) % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return self.chosen[order], bucket[order]

    def candidates(self, masks: dict, buckets: int) -> np.ndarray:
        """Windows whose minimum is found at two places or more, here or elsewhere."""
        key, bucket = self.minima(buckets)
        found = [self.chosen[self.times > 1]]
        at = np.searchsorted(bucket, np.arange(buckets + 1))
        for b, blob in masks.items():
            part = key[at[b] : at[b + 1]]
            found.append(part[_unpack(blob, len(part))])
        if not len(self.low):
            return np.zeros(0, np.int64)
        run = np.flatnonzero(np.concatenate(([True], self.low[1:] != self.low[:-1])))
        held = np.isin(self.low[run], np.concatenate(found))
        return np.flatnonzero(np.repeat(held, np.diff(np.append(run, len(self.low)))))

    def distinct(self, c: np.ndarray, buckets: int):
        """First occurrences among the candidate windows in order of (bucket, hash), their buckets, and for each candidate the number of its distinct window."""
        order = np.lexsort((c, self.b[c], self.a[c]))
        a, b = self.a[c][order], self.b[c][order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        number = np.empty(len(c), np.int64)
        number[order] = np.cumsum(new) - 1
        first = c[order[new]]
        bucket = (self.a[first] % U64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        return first[by], bucket[by], rank[number]


    def segments(self, masks: pa.Table, buckets: int, chunk: int, window: int) -> list[tuple[int, int, int, int]]:
        """(document, first word, number of words, block) of the runs of windows whose earliest places lie in one block."""
        c = self.candidates(_answers(masks, 1), buckets)
        first, bucket, number = self.distinct(c, buckets)
        source = np.full(len(first), -1, np.int64)
        at = np.searchsorted(bucket, np.arange(buckets + 1))
        for k, (bits, blocks) in _answers(masks, 2).items():
            late = at[k] + np.flatnonzero(_unpack(bits, at[k + 1] - at[k]))
            source[late] = np.frombuffer(blocks, np.int32)
        if not len(c):
            return []
        of = source[number]
        of[(of < 0) & (first[number] != c)] = chunk  # repeated within the block
        c, of = c[of >= 0], of[of >= 0]
        doc, start = self.doc[c], self.start[c]
        new = np.ones(len(c), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (of[1:] != of[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(c))) + window - 1
        return list(zip(doc[begin].tolist(), start[begin].tolist(), size.tolist(), of[begin].tolist(), strict=True))

    def passages(self, found: list[tuple[int, int, int, int]]):
        """(digest, words, segment) of each segment."""
        at, parts = -1, []
        for segment in found:
            if segment[0] != at:
                at = segment[0]
                parts = self.texts[at].as_buffer().to_pybytes().split()
            text = b" ".join(parts[segment[1] : segment[1] + segment[2]])
            yield hashlib.blake2b(text, digest_size=16).digest(), text, segment


def _answers(masks: pa.Table, kind: int) -> dict:
    rows = zip(*(masks[c].to_pylist() for c in ("kind", "bucket", "bits", "more")), strict=True)
    if kind == 1:
        return {b: bits for k, b, bits, _ in rows if k == 1}
    return {b if kind == 2 else (bits, b): (bits, more) for k, b, bits, more in rows if k == kind}


class Reference:
    """A block's words and the places of the windows that are asked for, in order."""

    def __init__(self, texts: pa.Array, ids: np.ndarray, asked: np.ndarray, window: int):
        self.words, self.window = words(texts), window
        w = self.words
        self.ids = ids[w.doc]
        self.end = np.searchsorted(w.doc, w.doc, "right") if len(w.doc) else w.doc  # of the word's document
        g = grams(w, window, 1)
        place = np.flatnonzero((w.doc[: len(g)] == w.doc[window - 1 :]) & np.isin(g, asked)) if len(g) else np.zeros(0, np.int64)
        order = np.argsort(g[place], kind="stable")
        self.place, self.hash = place[order], g[place][order]

    def longest(self, s: Words, i: int, end: int, low: int, high: int, least: int) -> int:
        """Length of the longest factor from word i on: at the window's first place, or another in a document before ``least``."""
        w, at = self.words, self.place[low:high]
        if len(at) > 1:
            at = np.concatenate((at[:1], at[1 : 8 * PLACES][self.ids[at[1 : 8 * PLACES]] < least]))[:PLACES]
        length = self._extended(s, i, end, at)
        for n in np.argsort(-length, kind="stable") if len(at) > 1 else (0,):
            of, own = slice(at[n], at[n] + length[n]), slice(i, i + length[n])
            equal = same(s.wide, s.first[own], s.size[own], w.wide, w.first[of], w.size[of], s.data, w.data)
            run = int(length[n]) if equal.all() else int(equal.argmin())
            if run >= self.window:
                return run
        return 0

    def _extended(self, s: Words, i: int, end: int, at: np.ndarray) -> np.ndarray:
        """How many words from word i on have the hashes of those from each place on."""
        w, most = self.words, np.minimum(end - i, self.end[at] - at)
        if len(at) == 1:
            equal = w.hash[at[0] : at[0] + most[0]] == s.hash[i : i + most[0]]
            return most if equal.all() else np.array([int(equal.argmin())])
        length, alive, step = np.zeros(len(at), np.int64), np.arange(len(at)), 32
        while len(alive):
            k = length[alive][:, None] + np.arange(step)
            inside = k < most[alive][:, None]
            equal = inside & (w.hash[np.minimum(at[alive][:, None] + k, len(w.hash) - 1)] == s.hash[np.minimum(i + k, len(s.hash) - 1)])
            run = np.where(equal.all(1), step, equal.argmin(1))
            length[alive] += run
            alive, step = alive[run == step], 256
        return length

    def parse(self, s: Words, windows: np.ndarray, begin: int, end: int, least: int) -> list[int]:
        """Factors of the segment of words [begin, end): first word and last word + 1 of each, counted from the segment's first."""
        out, i = [], begin
        low = np.searchsorted(self.hash, windows[begin : end - self.window + 1])
        high = np.searchsorted(self.hash, windows[begin : end - self.window + 1], "right")
        while i + self.window <= end:
            n = self.longest(s, i, end, low[i - begin], high[i - begin], least) if high[i - begin] > low[i - begin] else 0
            if n:
                out += [i - begin, i - begin + n]
            i += max(1, n - self.window + 1)
        return out


def remove_repeats(docs: DataFrame, window: int = 20, phrase: int = 6, block_bytes: int = 1 << 21, texts: bool = False) -> DataFrame:
    """Removes each word covered by a window of words that also starts earlier.

    Earlier: in a document with a smaller id, or before in the same document. What
    is repeated is judged on the input. Returns doc_id, n_words, n_removed,
    kept_sha256 (hex digest of the kept words joined by a space), n_factors and
    spans (array of [first word, last word + 1) as flat longs); with ``texts`` also
    the input's other columns and ``kept_text`` (the text itself where nothing goes).

    Defined cases: null and empty texts have no words; a null id is smaller than all
    others; rows that share an id come one after another in order of their texts, so
    of a repeated row the later copy is removed; a text of fewer than ``window`` words keeps all; no row is dropped. Tables without
    rows give none. Extra columns are ignored (kept with ``texts``).
    """
    spark = docs.sparkSession
    least = shuffle_partitions(spark)
    _, volume = text_volume(docs)
    grow = min(16, max(1, int((volume / (1 << 32)) ** 0.5)))
    chunks = pieces_for(volume, grow * block_bytes, 2 * least)
    buckets = pieces_for(volume // 44, grow << 20, least)
    other = [c for c in docs.columns if c not in ("doc_id", "text")] if texts else []
    extra = [F.struct(*[F.col(f"`{c}`") for c in other]).alias("_extra")] if other else []
    blocks = docs.select(
        F.col("doc_id").cast("long").alias("_did"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("_id"), F.coalesce("text", F.lit("")).alias("_text"), *extra
    ).withColumn("chunk", F.pmod(F.xxhash64("_id"), F.lit(chunks)))

    def send(kind: int, bucket: np.ndarray, chunk: int, *columns: np.ndarray) -> pa.Table:
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
        ends = [*at[1:], len(bucket)]
        blobs = [[c[i:j].tobytes() for i, j in zip(at, ends, strict=True)] for c in columns] if len(at) else [[] for _ in columns]
        out = {"bucket": pa.array(bucket[at].astype(np.int32) if len(at) else [], pa.int32()), "chunk": pa.array([chunk] * len(at), pa.int64())}
        return pa.table(out | {f"c{i}": pa.array(x, pa.binary()) for i, x in enumerate(blobs)})

    def first_round(table: pa.Table) -> pa.Table:
        block = _Block(table, window, phrase, False)
        key, bucket = block.minima(buckets)
        return send(1, bucket, table["chunk"][0].as_py(), key.astype(np.uint32))

    def met(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, np.uint32) for x in table["c0"].to_pylist()]
        _, back, n = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        many = np.split((n > 1)[back], np.cumsum([len(x) for x in sent])[:-1])
        return answer(table, 1, many)

    def answer(table: pa.Table, kind: int, bits: list[np.ndarray], more: list[np.ndarray] | None = None) -> pa.Table:
        some = [i for i, x in enumerate(bits) if x.any()]
        return pa.table(
            {
                "chunk": table["chunk"].combine_chunks().take(pa.array(some, pa.int64())),
                "kind": pa.array([kind] * len(some), pa.int32()),
                "bucket": table["bucket"].combine_chunks().take(pa.array(some, pa.int64())),
                "bits": pa.array([np.packbits(bits[i]).tobytes() for i in some], pa.binary()),
                "more": pa.array([more[i][bits[i]].astype(np.int32).tobytes() if more else None for i in some], pa.binary()),
            }
        )

    def second_round(left: pa.Table, masks: pa.Table) -> pa.Table:
        empty = send(2, np.zeros(0, np.int64), 0, *[np.zeros(0)] * 3)
        if not left.num_rows:
            return empty
        block = _Block(left, window, phrase, True)
        first, bucket, _ = block.distinct(block.candidates(_answers(masks, 1), buckets), buckets)
        return send(2, bucket, left["chunk"][0].as_py(), block.a[first], block.b[first], block.ids[block.doc[first]])

    def earlier(table: pa.Table) -> pa.Table:
        parts = [[np.frombuffer(x, kind) for x in table[f"c{i}"].to_pylist()] for i, kind in enumerate((U64, np.uint32, np.int64))]
        a, b, ids = map(np.concatenate, parts)
        order = np.lexsort((ids, b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        sender = np.repeat(table["chunk"].to_numpy(), [len(x) for x in parts[0]])
        of = np.cumsum(new) - 1
        late, source = np.empty(len(a), bool), np.empty(len(a), np.int64)
        late[order] = ids[order] > ids[order][new][of]
        source[order] = sender[order][new][of]
        ends = np.cumsum([len(x) for x in parts[0]])[:-1]
        return answer(table, 2, np.split(late, ends), np.split(source, ends))

    def third_round(left: pa.Table, masks: pa.Table) -> pa.Table:
        out: dict[tuple[int, bytes], tuple[bytes, int]] = {}
        chunk = left["chunk"][0].as_py() if left.num_rows else 0
        if left.num_rows:  # a block without answers may repeat itself
            block = _Block(left, window, phrase, True)
            for digest, text, (doc, _, _, source) in block.passages(block.segments(masks, buckets, chunk, window)):
                out.setdefault((source, digest), (text, int(block.ids[doc])))  # ids ascend
        columns = [list(x) for x in zip(*((source, digest, text, least, chunk) for (source, digest), (text, least) in out.items()), strict=True)] or [[]] * 5
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["source", "digest", "words", "least", "chunk"])

    def parsed(left: pa.Table, asked: pa.Table) -> pa.Table:
        out = [[] for _ in range(5)]
        if left.num_rows and asked.num_rows:
            order = left.select(["_id", "_text"]).sort_by([("_id", "ascending"), ("_text", "ascending")]).combine_chunks()
            texts = asked["words"].combine_chunks()
            s = words(texts)
            windows = grams(s, window, 1)
            reference = Reference(order["_text"].combine_chunks(), order["_id"].to_numpy(), np.unique(windows), window)
            bounds = np.searchsorted(s.doc, np.arange(len(texts) + 1))
            for n, (digest, least, chunks_) in enumerate(zip(*(asked[c].to_pylist() for c in ("digest", "least", "chunks")), strict=True)):
                factors = np.array(reference.parse(s, windows, bounds[n], bounds[n + 1], least), np.int32).tobytes()
                for chunk in chunks_:
                    for column, x in zip(out, (chunk, 3, asked["source"][0].as_py(), digest, factors), strict=True):
                        column.append(x)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["chunk", "kind", "bucket", "bits", "more"])

    def finish(left: pa.Table, masks: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out_schema.empty_table()
        block = _Block(left, window, phrase, True)
        answers = _answers(masks, 3)
        found: dict[int, list[tuple[int, int]]] = {}
        for digest, _, (doc, start, _, source) in block.passages(block.segments(masks, buckets, left["chunk"][0].as_py(), window)):
            factors = np.frombuffer(answers[digest, source][1], np.int32).reshape(-1, 2) + start
            found.setdefault(doc, []).extend(map(tuple, factors.tolist()))
        removed, spans, factors, digests, kept = [], [], [], [], []
        for d, raw in enumerate(block.texts):
            raw = raw.as_buffer().to_pybytes()
            parts = raw.split()
            flat, n = [], 0
            if d in found:
                n, keep, i = len(found[d]), [], 0
                for x, y in sorted(found[d]):
                    if flat and x <= flat[-1]:
                        flat[-1] = max(flat[-1], y)
                    else:
                        keep += parts[i:x]
                        flat += [x, y]
                    i = max(i, y)
                parts = keep + parts[i:]
            text = b" ".join(parts)
            removed.append(int(block.n_words[d]) - len(parts))
            spans.append(flat)
            factors.append(n)
            digests.append(hashlib.sha256(text).hexdigest())
            if texts:
                kept.append(text.decode() if flat else raw.decode())
        rows = pa.array(block.rows)
        result = {
            "doc_id": left["_did"].combine_chunks().take(rows),
            "n_words": pa.array(block.n_words, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
            "n_factors": pa.array(factors, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.int64())),
        }
        if texts:
            result["kept_text"] = pa.array(kept, pa.string())
        if other:
            result["_extra"] = left["_extra"].combine_chunks().take(rows)
        return pa.table(result)

    names = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long, spans array<long>"
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("n_factors", pa.int64()), ("spans", pa.list_(pa.int64()))]
    if texts:
        names += ", kept_text string"
        fields.append(("kept_text", pa.string()))
    if other:
        names += f", _extra {blocks.schema['_extra'].dataType.simpleString()}"
    out_schema = pa.schema(fields)

    minima = blocks.groupBy("chunk").applyInArrow(first_round, "bucket int, chunk long, c0 binary")
    repeated = minima.groupBy("bucket").applyInArrow(met, _ANSWER)
    windows = blocks.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(second_round, "bucket int, chunk long, c0 binary, c1 binary, c2 binary")
    late = windows.groupBy("bucket").applyInArrow(earlier, _ANSWER)
    both = repeated.unionByName(late)
    segments = blocks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(third_round, "source long, digest binary, words binary, least long, chunk long")
    distinct = segments.groupBy("source", "digest").agg(F.first("words").alias("words"), F.min("least").alias("least"), F.collect_list("chunk").alias("chunks"))
    factors = blocks.groupBy("chunk").cogroup(distinct.groupBy("source")).applyInArrow(parsed, _ANSWER)
    result = blocks.groupBy("chunk").cogroup(both.unionByName(factors).groupBy("chunk")).applyInArrow(finish, names)
    return result.select("*", "_extra.*").drop("_extra") if other else result
