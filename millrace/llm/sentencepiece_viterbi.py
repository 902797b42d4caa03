"""Encoding and decoding with a SentencePiece vocabulary by streaming Viterbi.

The best path maximises the sum of the pieces' scores from the model file (ties: the
longer last piece). The stream keeps back pointers for a window of positions only.
Once the window is twice the longest piece, the paths of all positions that a piece
could still extend, and that some path reaches, are followed back together, the latest
always first, until one boundary is left; the ids before it are committed and the window
is cut there. A position that no path reaches has none that survives and does not count. Paths that do not
converge, as in a run of one sign whose pieces can be shifted against each other, are
followed again when the window has doubled, so such a run takes time in proportion, too.

Where no piece of the vocabulary holds two neighbouring characters in that order,
every path has a boundary between them. Texts are cut there first, and each distinct
segment is encoded once while it stays in memory.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

SPACE = "▁"
_PARTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Vocabulary:
    """Pieces, scores and byte pieces of a model file, and a memory of encoded segments."""

    def __init__(self, path: str, most: int = 1_000_000):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.byte_ids = [-1] * 256
        self.bytes_of = [x.replace(SPACE, " ").encode() for x in self.pieces]
        self.trie: dict = {}
        self.longest, lowest = 1, 0.0
        pairs = set()
        for i, piece in enumerate(self.pieces):
            if p.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                node = self.trie
                for ch in piece:
                    node = node.setdefault(ch, {})
                score = p.get_score(i)
                node[""] = (i, score)
                lowest, self.longest = min(lowest, score), max(self.longest, len(piece))
                pairs.update(zip(piece, piece[1:], strict=False))
        self.unknown_id, self.unknown_score = p.unk_id(), lowest - 10
        self.pairs, self.most = pairs, most
        self.sign = np.array(self._plain(SPACE), "<u4").tobytes()
        self.words: dict[str, bytes] = {}
        self.segments: dict[str, list[int]] = {}

    def stream(self, text: str, commits: list | None = None):
        """Yields lists of ids as soon as they are certain; ``commits`` collects (size of the window, characters committed)."""
        trie, unknown, longest = self.trie, self.unknown_score, self.longest
        base, n, due = 0, len(text), 2 * longest  # positions below base are committed
        best, back = [0.0], [(0, -1)]
        for i in range(n):
            here, node, j = best[i - base], trie, i
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                found = node.get("")
                if found:
                    self._relax(best, back, j - base, here + found[1], i, found[0])
            if "" not in trie.get(text[i], ()):
                self._relax(best, back, i + 1 - base, here + unknown, i, -1)
            if i + 1 - base >= due:
                open_ends = {base + e for e in range(i + 1 - base, len(best)) if best[e] is not None}
                while len(open_ends) > 1:
                    last = max(open_ends)
                    open_ends.remove(last)
                    open_ends.add(back[last - base][0])
                cut = open_ends.pop()
                if commits is not None:
                    commits.append((i + 1 - base, cut - base))
                if cut > base:
                    yield self._trace(text, back, base, cut)
                    best, back = best[cut - base :], [(0, -1), *back[cut - base + 1 :]]
                    base = cut
                due = 2 * max(longest, i + 1 - base) if cut == base else max(2 * longest, i + 1 - base + longest)
        if n > base:
            yield self._trace(text, back, base, n)

    @staticmethod
    def _relax(best: list, back: list, at: int, score: float, start: int, piece: int) -> None:
        while len(best) <= at:
            best.append(None)
            back.append(None)
        if best[at] is None or score > best[at]:
            best[at], back[at] = score, (start, piece)

    def _trace(self, text: str, back: list, base: int, end: int) -> list[int]:
        out: list[list[int]] = []
        while end > base:
            start, piece = back[end - base]
            if piece >= 0:
                out.append([piece])
            else:
                out.append(self._plain(text[start:end]))
            end = start
        return [i for part in reversed(out) for i in part]

    def _plain(self, text: str) -> list[int]:
        """Ids of the text's bytes, or the unknown piece where the vocabulary has no byte pieces."""
        return [self.byte_ids[b] for b in text.encode()] if min(self.byte_ids) >= 0 else [self.unknown_id]

    def segment(self, text: str) -> list[int]:
        ids = self.segments.get(text)
        if ids is None:
            ids = [i for part in self.stream(text) for i in part]
            if len(text) <= 64:
                self.segments[text] = ids
        return ids

    def word(self, text: str) -> bytes:
        out, start, pairs = [], 0, self.pairs
        for i in range(1, len(text)):
            if (text[i - 1], text[i]) not in pairs:
                out += self.segment(text[start:i])
                start = i
        out += self.segment(text[start:])
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a space is put before the text.

        The sign that stands for a space in pieces is encoded by its bytes where the text itself
        holds it, so that it comes back as it was.
        """
        if not text:
            return b""
        if len(self.words) + len(self.segments) > self.most:
            self.words.clear()
            self.segments.clear()
        words, parts = self.words, []
        for n, piece in enumerate((" " + text).split(SPACE)):
            if n:
                parts.append(self.sign)
            for part in _PARTS.findall(piece.replace(" ", SPACE)):
                ids = words.get(part)
                if ids is None:
                    ids = self.word(part)
                    if len(part) <= 64:
                        words[part] = ids
                parts.append(ids)
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode(errors="replace")[1:]


_loaded: dict[str, Vocabulary] = {}


def vocabulary_at(path: str) -> Vocabulary:
    """One vocabulary a worker process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Adds ``ids`` (binary, little-endian unsigned 32-bit), replacing a column of that name.

    A null text has null ids, an empty one none. All rows are kept. Characters without
    a piece become their UTF-8 byte pieces. Other columns pass through unchanged, but for one named ``ids``.
    """
    docs = docs.drop("ids")
    at = docs.columns.index("text")

    def scan(batches):
        v = vocabulary_at(model)
        for batch in batches:
            ids = [None if t is None else v.encode(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], [*batch.schema.names, "ids"])

    return docs.mapInArrow(scan, StructType([*docs.schema.fields, StructField("ids", BinaryType())]))


def decode(df: DataFrame, model: str) -> DataFrame:
    """Replaces ``ids`` by ``decoded``: the text they stand for (null for null)."""
    df = df.drop("decoded")
    at = df.columns.index("ids")

    def scan(batches):
        v = vocabulary_at(model)
        for batch in batches:
            texts = [None if b is None else v.decode(np.frombuffer(b, "<u4")) for b in batch.column(at).to_pylist()]
            columns, names = [list(x) for x in (batch.columns, batch.schema.names)]
            columns[at], names[at] = pa.array(texts, pa.string()), "decoded"
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = [f"`{c}`" if c != "ids" else "CAST(NULL AS STRING) AS decoded" for c in df.columns]
    return df.mapInArrow(scan, df.selectExpr(*fields).schema)


def digest(docs: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, n_ids, ids_crc32, and whether the ids decode to the text.

    ``doc_id`` is cast to long. A null text counts as an empty one, which has no ids; all
    rows are kept, repeated ones and null ids too; extra columns are ignored; no rows give none.
    """

    def scan(batches):
        v = vocabulary_at(model)
        for batch in batches:
            n, crc, same = [], [], []
            for t in batch.column(1).to_pylist():
                ids = v.encode(t or "")
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                same.append(v.decode(np.frombuffer(ids, "<u4")) == (t or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
