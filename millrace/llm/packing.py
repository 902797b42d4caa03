"""Packing of documents into token sequences: concatenate and cut.

Pass 1 tokenizes every document once and writes the ids with the document's offset
inside its partition. The partitions' totals, one row each, are summed up to the
offset of every partition. Pass 2 adds both, cuts each document where a multiple of
the sequence length falls, and writes a boundary record for every piece. No text or
ids are shuffled. All sequences but the last are full.

What goes through one window and to every task is a row for each task of pass 1: with input
partitions of 128 MB that is under a million rows, some 20 MB, at 100 TB.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .words import U64, Words, same, slices, words


class WordTokenizer:
    """Ids of words, each distinct word tokenized once while it stays in memory.

    Holds for tokenizers that drop white space and never join two words, such as the
    word-end BPE this module is used with. New words are tokenized together, joined by
    spaces, and parted again by the places of their tokens. The memory is an
    open-addressing table in arrays; a word counts as known only if its bytes
    are those kept with the hash. ``most`` bounds the words held.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.clear()

    def clear(self) -> None:
        self.n, self.slots = 0, np.full(1 << 16, -1, np.int32)
        self.hash = np.zeros(1 << 14, U64)
        self.at, self.size, self.first, self.count = (np.zeros(1 << 14, np.int64) for _ in range(4))  # bytes and ids of each word
        self.letters, self.n_letters = np.zeros(1 << 18, np.uint8), 0
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def find(self, w: Words, of: np.ndarray) -> np.ndarray:
        """Number of the entry with the hash of each of the words ``of``, or -1."""
        h, mask, out, left = w.hash[of], len(self.slots) - 1, np.full(len(of), -1, np.int64), np.arange(len(of))
        place = (h & U64(mask)).astype(np.int64)
        while len(left):
            entry = self.slots[place[left]].astype(np.int64)
            hit = (entry >= 0) & (self.hash[entry] == h[left])
            out[left[hit]] = entry[hit]
            left = left[(entry >= 0) & ~hit]
            place[left] = (place[left] + 1) & mask
        return out

    def right(self, w: Words, of: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Whether the entries hold the words' bytes."""
        wide = self.letters[: len(self.letters) // 8 * 8].view(U64)
        return same(w.wide, w.first[of], w.last[of] - w.first[of], wide, self.at[entry], self.size[entry], w.data, self.letters)

    def tokenize(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids of each word)."""
        parts = [x.decode() for x in parts]
        found = self.tokenizer.encode(" ".join(parts), add_special_tokens=False)
        begin = np.cumsum([0, *[len(x) + 1 for x in parts[:-1]]])
        place = np.fromiter((x for x, _ in found.offsets), np.int64, len(found.ids))
        return np.array(found.ids, np.uint32), np.bincount(np.searchsorted(begin, place, "right") - 1, minlength=len(parts))

    def add(self, w: Words, of: np.ndarray, known: bool) -> np.ndarray:
        """Makes entries of the words ``of``; with ``known`` they can be found later."""
        n, sizes = len(of), w.last[of] - w.first[of]
        words_ = [w.data[a:b].tobytes() for a, b in zip(w.first[of].tolist(), w.last[of].tolist(), strict=True)]
        ids, count = self.tokenize(words_)
        fill = lambda x, used, new: x if used + new <= len(x) - 16 else np.concatenate((x, np.zeros(max(len(x), -(-new // 8) * 8 + 16), x.dtype)))
        self.pool, self.letters = fill(self.pool, self.used, len(ids)), fill(self.letters, self.n_letters, int(sizes.sum()))
        self.hash, self.at, self.size, self.first, self.count = (fill(x, self.n, n) for x in (self.hash, self.at, self.size, self.first, self.count))
        new = slice(self.n, self.n + n)
        self.hash[new], self.size[new], self.count[new] = w.hash[of], sizes, count
        self.at[new] = self.n_letters + np.cumsum(sizes) - sizes
        self.first[new] = self.used + np.cumsum(count) - count
        self.letters[self.n_letters : self.n_letters + sizes.sum()] = np.frombuffer(b"".join(words_), np.uint8)
        self.pool[self.used : self.used + len(ids)] = ids
        self.n, self.n_letters, self.used = self.n + n, self.n_letters + int(sizes.sum()), self.used + len(ids)
        entries = np.arange(self.n - n, self.n)
        if known:
            if 2 * self.n > len(self.slots):
                old = self.slots[self.slots >= 0].astype(np.int64)
                self.slots = np.full(4 * len(self.slots), -1, np.int32)
                self._place(old)
            self._place(entries)
        return entries

    def _place(self, entries: np.ndarray) -> None:
        mask = len(self.slots) - 1
        place = (self.hash[entries] & U64(mask)).astype(np.int64)
        while len(entries):
            free = self.slots[place] < 0
            self.slots[place[free]] = entries[free]
            left = self.slots[place] != entries
            entries, place = entries[left], (place[left] + 1) & mask

    def encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each), ``end`` after each text."""
        if self.n > self.most:
            self.clear()
        w = words(texts)
        every = np.arange(len(w.hash))
        number = self.find(w, every)
        new = every[number < 0]
        if len(new):
            _, at = np.unique(w.hash[new], return_index=True)
            for i in range(0, len(at), 1 << 15):
                self.add(w, new[at[i : i + (1 << 15)]], True)
            number[new] = self.find(w, new)
        odd = every[~self.right(w, every, number)]  # another word has the same hash
        if len(odd):
            number[odd] = self.add(w, odd, False)
        size = self.count[number]
        per_doc = np.bincount(w.doc, size, w.n_docs).astype(np.int64)
        tail = int(end is not None)
        out = np.empty(int(per_doc.sum()) + tail * w.n_docs, np.uint32)
        place = np.cumsum(size) - size + tail * w.doc  # before each word: the ends of the texts before
        shift = np.repeat(self.first[number] - place, size)
        to = np.repeat(place - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out[to] = self.pool[shift + to]
        if tail:
            out[np.cumsum(per_doc + 1) - 1] = end
        return out, per_doc + tail


_loaded: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    """One tokenizer a worker process."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def pack(docs: DataFrame, tokenizer: str, end: int, length: int = 4096, ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of ``length`` tokens.

    Returns a row for each piece: doc_id, start (the document's ids before it),
    length, ids_crc32 (of the ids as little-endian unsigned 32-bit integers),
    doc_tokens (with ``end``), sequence_id, offset (gapless from 0), and with ``ids`` the
    piece's ids. Sequences are in no stated order of documents.

    Defined cases: a null or empty text is the token ``end`` alone; repeated rows and
    ids are packed each; null ids stay null; no rows give no pieces; extra columns
    are ignored. Only the last sequence may be shorter than ``length``.
    """

    def tokenize(batches):
        part, total, words_of = TaskContext.get().partitionId(), 0, tokenizer_at(tokenizer)
        for batch in batches:
            for i, j in slices(batch.column(1)):
                found, sizes = words_of.encode(batch.column(1)[i:j], end)
                ends = np.cumsum(sizes)
                blobs = [found[e - n : e].astype("<u4").tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array([part] * (j - i), pa.int32()), pa.array(ends - sizes + total, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())],
                    ["doc_id", "part", "at", "n", "ids"],
                )
                total += int(ends[-1])

    def cut(batches):
        for batch in batches:
            out = [[] for _ in range(8)]
            for doc, at, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                data, start = blob.as_buffer().to_pybytes(), 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    piece = data[4 * start : 4 * (start + size)]
                    for column, x in zip(out, (doc, start, size, zlib.crc32(piece), n, sequence, offset, piece), strict=True):
                        column.append(x)
                    start += size
            arrays = [pa.array(x, pa.int64()) for x in out[:7]]
            if ids:
                sizes = np.concatenate(([0], np.cumsum(out[2]))).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.frombuffer(b"".join(out[7]), "<u4").astype(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if ids else [])]
    data = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tokens = stored(data.mapInArrow(tokenize, "doc_id long, part int, at long, n long, ids binary"), compression="zstd")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))  # a row for each task of pass 1
    placed = tokens.join(F.broadcast(starts), "part").select("doc_id", (F.col("base") + F.col("at")).alias("at"), "n", "ids")
    return placed.mapInArrow(cut, ", ".join(f"{x} long" if x != "ids" else "ids array<int>" for x in names))
