"""Alignment of two tokenizers over a corpus, by inverted pair bitmaps.

Tokens of both tokenizers lie on the same bytes. Where a token of each ends, the text is
cut into groups, and the two tokens that end there are a link. For each pair of ids an
index holds which documents link it, and how often:

1. Documents are numbered inside blocks. Per pair and block one posting holds a compressed
   bitmap of the documents, merged by OR from the slices the block was read in, and
   multiplicity planes: plane k has the documents whose number of links has bit k set.
2. Per pair the bitmaps are popcounted in Spark: documents from the OR, links from the planes.
   The sums are combined before the shuffle, so a pair of every document is a row a block.
3. The counts go back along the postings: each adds its pair's count to the documents of its
   bitmap, and these sums meet by document.

Of two tokens that end together one is a suffix of the other, so there can be no more
pairs than twice the bytes of both vocabularies (``most_pairs``), whatever the corpus; that is
the bound of what is broadcast.

Both tokenizers never join a character other than white space with a space after it. Texts are cut there, and each
distinct piece is tokenized and aligned once while it stays in a worker's memory.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .words import Words, eights, run_hash, slices, text_bytes, word_numbers

U32 = np.uint32
#: A block is as many documents as two bytes can number, or fewer.
BLOCK_DOCS = 1 << 15
_SPACE_SIGN = "▁"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Bytes that print stand for themselves; the others, in order, have the characters from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_bpe), sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        self.a.encode_special_tokens = True
        of = byte_level()
        names = {i: x for x, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(of[c] for c in names[i]) if all(c in of for c in names.get(i, "")) else b"" for i in range(max(names) + 1)]
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(_SPACE_SIGN, " ").encode() for i, x in enumerate(pieces)]
        if any(_SPACE_SIGN in x.lstrip(_SPACE_SIGN) for i, x in enumerate(pieces) if not self.b.is_byte(i)):
            raise ValueError("a piece goes on after a space, so texts can't be cut there")
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))

    def most_pairs(self) -> int:
        """Pairs of ids that can ever end together: one is a suffix of the other, and two ids of a vocabulary may share their bytes."""
        return 2 * int(self.a_size.sum() + self.b_size.sum())

    def encode(self, text: str, inside: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids by both; None where the tokens' bytes are not the text. ``text`` starts with a space; with ``inside`` other text precedes."""
        a = self.a.encode(text, add_special_tokens=False).ids
        # a word put before keeps pieces of spaces alone, which a text of nothing else would not give
        b = self.b.encode("a" + text, num_threads=1)[1:] if inside else self.b.encode(text[1:], num_threads=1)
        raw = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


class Pieces:
    """Aligned pieces of texts, each aligned once while it is held; ``most`` bounds about how many bytes are."""

    def __init__(self, pair: Pair, most: int = 1 << 27):
        self.pair, self.most = pair, most
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.held = 0
        self.groups: list[bytes | None] = []
        self.counts = np.zeros((0, 4), np.int64)  # a, b, groups, first link in ``links``
        self.links = np.zeros(0, U32)

    def find(self, parts: list[bytes]) -> np.ndarray:
        """The entry of each part; new ones are aligned together."""
        if self.held > self.most:
            self.clear()
        new = [x for x in parts if x not in self.number]
        if new:
            self._add(new)
        return np.fromiter((self.number[x] for x in parts), np.int64, len(parts))

    def _add(self, new: list[bytes]) -> None:
        counts, links, at = [], [self.links], len(self.links)
        batch: list[bytes] = []
        size = 0
        for x in [*new, None]:
            # pieces that end in white space, or hold the space sign, are not parted from what follows by all rules
            odd = x is not None and (x.decode()[-1].isspace() or _SPACE_SIGN.encode() in x)
            if batch and (x is None or size > 1 << 16):
                found = self.pair.encode(b"".join(batch).decode(), False)
                for y, entry in zip(batch, self._cut(batch, found), strict=True):
                    self._enter(y, entry, counts, links)
                batch, size = [], 0
            if odd:
                text = x.decode()
                found = self.pair.encode(text, True)
                self._enter(x, None if found is None else self._cut([x], found)[0], counts, links)
            elif x is not None:
                batch.append(x)
                size += len(x)
        self.links = np.concatenate(links)
        rows = np.array(counts, np.int64).reshape(-1, 4)
        rows[:, 3] = at + np.cumsum(rows[:, 2]) - rows[:, 2]
        self.counts = np.concatenate((self.counts, rows))

    def _enter(self, x: bytes, entry, counts: list, links: list) -> None:
        self.number[x] = len(self.groups)
        n_a, n_b, linked, text = entry or (0, 0, np.zeros(0, U32), None)
        self.held += 300 + len(x) + len(text or b"") + 4 * len(linked)
        self.groups.append(text)
        counts.append((n_a, n_b, len(linked), 0))
        links.append(linked)

    def _cut(self, parts: list[bytes], found) -> list:
        """(number of A ids, of B ids, links, groups as text) of each part."""
        if found is None:
            return [None] * len(parts) if len(parts) == 1 else [self._cut([x], self.pair.encode(x.decode(), True))[0] for x in parts]
        a, b = found
        a_end, b_end = np.cumsum(self.pair.a_size[a]), np.cumsum(self.pair.b_size[b])
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        in_a, in_b = np.searchsorted(a_end, both) + 1, np.searchsorted(b_end, both) + 1
        linked = (a[in_a - 1] << 16 | b[in_b - 1]).astype(U32)
        last = np.searchsorted(both, np.cumsum([len(x) for x in parts])) + 1  # groups up to the end of each part
        a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups, i, j = [], 0, 0
        for x, y in zip(in_a.tolist(), in_b.tolist(), strict=True):
            groups.append(",".join(a_text[i:x]) + "|" + ",".join(b_text[j:y]))
            i, j = x, y
        out, before, a_before, b_before = [], 0, 0, 0
        for n in last.tolist():
            a_here, b_here = int(in_a[n - 1]), int(in_b[n - 1])
            out.append((a_here - a_before, b_here - b_before, linked[before:n], ";".join(groups[before:n]).encode()))
            before, a_before, b_before = n, a_here, b_here
        return out


_loaded: dict[tuple[str, str], Pieces] = {}


def pieces_at(byte_bpe: str, piece_bpe: str) -> Pieces:
    """One memory of pieces a worker process."""
    key = byte_bpe, piece_bpe
    if key not in _loaded:
        _loaded[key] = Pieces(Pair(*key))
    return _loaded[key]


def cut_texts(texts: pa.Array) -> Words:
    """Pieces of texts: a new one starts at each space whose character before is surely no white space."""
    data, at = text_bytes(texts)
    n_docs, n = len(at) - 1, len(data)
    wide = eights(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, wide, none, none, none, np.zeros(0, np.uint64), n_docs)
    one, two, three = (np.concatenate((np.zeros(i, np.uint8), data[: n - i] if i < n else data[:0]))[:n] for i in (1, 2, 3))
    # white space beyond ASCII is C2 xx, or three bytes of which the first two are among these
    odd = (one < 0x80) & (one <= 0x20) | (one >= 0x80) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3) & ((two == 0x9A) | (two == 0x80) | (two == 0x81))))
    begins = (data == 0x20) & ~odd
    begins[at[:-1][at[:-1] < n]] = True  # of texts; empty ones begin where the next does
    first = np.flatnonzero(begins)
    last = np.append(first[1:], n)
    doc = np.searchsorted(at, first, "right") - 1
    return Words(data, wide, first, last, doc, run_hash(data, wide, first, last), n_docs)


def pack_sets(of: np.ndarray, docs: np.ndarray, n_sets: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of compressed sets; ``of`` ascends, and documents ascend in each set.

    A set of few documents is their numbers, two bytes each; others are a bitmap. A bitmap's
    length is odd, so the length tells which.
    """
    width = (n_docs + 7) // 8 | 1
    count = np.bincount(of, minlength=n_sets)
    dense = 2 * count > width
    size = np.where(dense, width, 2 * count)
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(int(at[-1]), np.uint8)
    rank = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    few = ~dense[of]
    to = at[of[few]] + 2 * rank[few]
    out[to], out[to + 1] = docs[few] & 255, docs[few] >> 8
    if not few.all():
        place = at[of[~few]] + (docs[~few] >> 3)
        out += np.bincount(place, 1 << (docs[~few] & 7), len(out)).astype(np.uint8)  # each bit is set once
    return out, at


def unpack_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, document) of every member of the sets that ``pack_sets`` made."""
    size = np.diff(at)
    dense = (size & 1).astype(bool)
    few = np.flatnonzero(~dense)
    n = size[few] // 2
    place = np.repeat(at[:-1][few] - 2 * (np.cumsum(n) - n), n) + 2 * np.arange(int(n.sum()))
    sets, docs = [np.repeat(few, n)], [data[place].astype(np.int64) | data[place + 1].astype(np.int64) << 8]
    for i in np.flatnonzero(dense):
        found = np.flatnonzero(np.unpackbits(data[at[i] : at[i + 1]], bitorder="little"))
        sets.append(np.full(len(found), i))
        docs.append(found)
    return np.concatenate(sets), np.concatenate(docs)


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


class Block:
    """Postings of one block of documents, merged from slices."""

    def __init__(self, number: int):
        self.number, self.n_docs, self.size = number, 0, 0
        self.keys, self.times = [], []

    def add(self, links: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> None:
        """The links of a slice and the document of each, counted from the slice's first."""
        key, times = np.unique(links.astype(np.int64) << 16 | (doc + self.n_docs), return_counts=True)
        self.keys.append(key)
        self.times.append(times)
        self.n_docs, self.size = self.n_docs + n_docs, self.size + size

    def postings(self) -> Iterator[tuple]:
        """(pairs, sets of documents, planes) in parts, by pair: OR of all slices, and planes where a document links a pair twice or more."""
        key, times = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] >> 16 != key[:-1] >> 16))) if len(key) else np.zeros(0, np.int64)
        ends = np.append(begin[1:], len(key))
        i = 0
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(ends, begin[i] + (1 << 20), "right")))
            of = np.repeat(np.arange(j - i), ends[i:j] - begin[i:j])
            part = slice(begin[i], ends[j - 1])
            docs, n = key[part] & 0xFFFF, times[part]
            depth = np.zeros(j - i, np.int64)
            np.maximum.at(depth, of, n)
            planes = np.where(depth > 1, np.frexp(depth.astype(float))[1], 0)  # bits of the largest number
            first = np.concatenate(([0], np.cumsum(planes)))
            sets, members = [], []
            for k in range(int(planes.max(initial=0))):
                chosen = np.flatnonzero((planes[of] > k) & (n >> k & 1 == 1))
                sets.append(first[of[chosen]] + k)
                members.append(docs[chosen])
            sets, members = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sets, members))
            by = np.argsort(sets, kind="stable")
            plane_sets = _binary(*pack_sets(sets[by], members[by], int(first[-1]), self.n_docs))
            yield key[begin[i:j]] >> 16, _binary(*pack_sets(of, docs, j - i, self.n_docs)), pa.ListArray.from_arrays(pa.array(first, pa.int32()), plane_sets)
            i = j


_PASS_ONE = "block long, local int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, a int, b int, docs binary, planes array<binary>"
_NAMES = [x.split()[0] for x in _PASS_ONE.split(", ")]
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary())]


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, k) for c, k in zip(_NAMES, _KINDS, strict=True)], schema=pa.schema(list(zip(_NAMES, _KINDS, strict=True))))


def index(docs: DataFrame, byte_bpe: str, piece_bpe: str, block_bytes: int = 1 << 25) -> DataFrame:
    """The stored first pass: a row a document (``a`` is null) and a row a posting (``local`` is null)."""

    def read(batches):
        table, part, n_blocks = pieces_at(byte_bpe, piece_bpe), TaskContext.get().partitionId(), 0
        block = Block(part << 32)

        def close(block):
            if block.n_docs:
                for pairs, sets, planes in block.postings():
                    n = len(pairs)
                    yield _rows(n, block=pa.array(np.full(n, block.number)), a=pa.array((pairs >> 16).astype(np.int32)), b=pa.array((pairs & 0xFFFF).astype(np.int32)), docs=sets, planes=planes)

        for batch in batches:
            for i, j in slices(batch.column(1)):
                for k in range(i, j, BLOCK_DOCS):
                    texts, ids = batch.column(1)[k : min(j, k + BLOCK_DOCS)], batch.column(0)[k : min(j, k + BLOCK_DOCS)]
                    if block.n_docs + len(texts) > BLOCK_DOCS or block.size > block_bytes:
                        yield from close(block)
                        n_blocks += 1
                        block = Block(part << 32 | n_blocks)
                    w = cut_texts(texts)
                    number = word_numbers(w)
                    _, rep = np.unique(number, return_index=True)
                    entry = table.find([w.data[x:y].tobytes() for x, y in zip(w.first[rep].tolist(), w.last[rep].tolist(), strict=True)])[number]
                    broken = np.fromiter((table.groups[x] is None for x in entry[rep].tolist()), bool, len(rep))[number]
                    lost = np.bincount(w.doc, broken, w.n_docs) > 0
                    good = ~lost[w.doc]
                    doc, entry = w.doc[good], entry[good]
                    counts = table.counts[entry]
                    sums = [np.bincount(doc, counts[:, c], w.n_docs).astype(np.int64) for c in range(3)]
                    n = counts[:, 2]
                    place = np.repeat(counts[:, 3] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    ends = np.searchsorted(doc, np.arange(w.n_docs + 1))
                    text = [table.groups[x] for x in entry.tolist()]
                    shas = [hashlib.sha256(b";".join(text[x:y])).hexdigest() if y > x else "" for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    local = pa.array(np.arange(block.n_docs, block.n_docs + w.n_docs).astype(np.int32))
                    yield _rows(
                        w.n_docs, block=pa.array(np.full(w.n_docs, block.number)), local=local, doc_id=ids, groups_sha256=pa.array(shas), n_a=pa.array(sums[0]), n_b=pa.array(sums[1]), n_groups=pa.array(sums[2])
                    )
                    block.add(table.links[place], np.repeat(doc, n), w.n_docs, len(w.data))
        yield from close(block)

    text = F.when(F.length("text") > 0, F.concat(F.lit(" "), "text")).otherwise(F.lit(""))
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(read, _PASS_ONE), compression="zstd")


def popcount(packed: Column) -> Column:
    """Members of a set that ``pack_sets`` made."""
    size = F.octet_length(packed)
    return F.when(size % 2 == 0, (size / 2).cast("long")).otherwise(F.bitmap_count(packed))


def pair_counts(indexed: DataFrame) -> DataFrame:
    """a, b, n_docs (documents with a link of the pair), count (links), best (no A id has more with this B id)."""
    weights = F.aggregate(F.transform("planes", lambda x, k: F.call_function("shiftleft", popcount(x), k)), F.lit(0).cast("long"), lambda s, x: s + x)
    n_docs = popcount(F.col("docs"))
    links = F.when(F.size("planes") > 0, weights).otherwise(n_docs)
    counts = indexed.where("a is not null").groupBy("a", "b").agg(F.sum(n_docs).alias("n_docs"), F.sum(links).alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def align(docs: DataFrame, byte_bpe: str, piece_bpe: str, block_bytes: int = 1 << 25) -> tuple[DataFrame, DataFrame]:
    """(a row a document, a row a pair of linked ids).

    Documents: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair is linked
    as often as any of its B id), count_sum (of the pairs' counts over all links), groups_sha256.
    Pairs: as ``pair_counts``.

    Tokenizer A reads a space and the text, B the text, before which it puts a space itself; strings of special
    tokens are plain text. A token's bytes are compared with those of the space and the text.

    Defined cases: texts that are null, empty, or not equal to the bytes of their tokens (such as those with U+2581,
    which B reads as a space) have zeros and the hash ''; every row has its own result, so repeated rows and ids count each; null ids stay
    null; no rows give no rows; extra columns are ignored.
    """
    indexed = index(docs, byte_bpe, piece_bpe, block_bytes)
    counts = stored(pair_counts(indexed))  # at most ``most_pairs`` rows

    def spread(batches):
        block, sums = None, np.zeros((0, 2), np.int64)

        def rows():
            some = np.flatnonzero(sums[:, 1])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block), pa.int64()), pa.array(some.astype(np.int32)), pa.array(sums[some, 0]), pa.array(sums[some, 1])], ["block", "local", "n_best", "count_sum"])

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1], [True]))) if len(blocks) else [0]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if blocks[i] != block:
                    if block is not None:
                        yield rows()
                    block, sums = int(blocks[i]), np.zeros((BLOCK_DOCS, 2), np.int64)
                lists = batch.column(3)[i:j]
                sets = lists.flatten()
                n = np.asarray(lists.value_lengths())
                of = np.repeat(np.arange(i, j), n)
                weight = 1 << (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
                which, doc = unpack_sets(*text_bytes(sets))
                count, best = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2))
                np.add.at(sums[:, 0], doc, (weight * best[of])[which])
                np.add.at(sums[:, 1], doc, (weight * count[of])[which])
        if block is not None:
            yield rows()

    planes = F.when(F.size("planes") > 0, F.col("planes")).otherwise(F.array("docs"))
    postings = indexed.where("a is not null").join(F.broadcast(counts), ["a", "b"]).select("block", "count", F.col("best").cast("int").alias("best"), planes.alias("planes"))
    found = postings.mapInArrow(spread, "block long, local int, n_best long, count_sum long").groupBy("block", "local").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = indexed.where("local is not null").select("block", "local", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    zero = F.lit(0).cast("long")
    result = rows.join(found, ["block", "local"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
    return result, counts
