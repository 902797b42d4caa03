"""Near-duplicate groups by b-bit MinHash, confirmed on full shingle sets.

1. A scan turns each document into a digest of its words in order, the size of its
   shingle set, a signature of the low ``bits`` bits of its minima (packed), and band keys
   made of full minima. Documents with equal words form a class, known up to the last
   step by its 128-bit digest, so rows that share an id are told apart by their words.
2. Classes that share a band key are candidates. First each is paired with the
   smallest class that shares one of its bands: one pair for each at most.
3. Pairs are estimated from the packed signatures by bit counts, corrected for
   chance collisions, and those that may reach the threshold are confirmed on the
   full sets, made anew from both texts: words and shingles count as equal there only if
   their bytes are (``shingle_numbers``), whatever their hashes.
4. Buckets whose members are then in different components are still open. Members
   that meet in open buckets form a field. A field's sets are compared in blocks,
   each pair of blocks in a task of its own, and only links that join components come
   out. Pairs within a component are never needed, so large groups of near copies
   stay linear in rows.

The estimate only rules a pair out when it is six standard errors below the
threshold. Bands have as many rows as the threshold allows (``rows_for``): a pair at
0.85 shares none of 24 bands of 5 rows with probability 8e-7, a pair at 0.8 none of 30
bands of 4 rows with 1e-7.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces_for, shuffle_partitions, stored
from .components import components
from .words import _LOWER, U64, Words, grams, mix, slices, text_bytes, word_numbers, words

MINIMA, BITS = 120, 4
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
LEAST_ID = -(2**63)
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def shingle_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all shingles; a document with fewer words has one, of all its words."""
    n = len(w.hash) - size + 1
    if n > 0:
        good = np.flatnonzero(w.doc[:n] == w.doc[size - 1 :])
        doc, h = w.doc[good], grams(w, size)[good]
    else:
        doc, h = np.zeros(0, np.int64), np.zeros(0, U64)
    count = w.per_doc()
    short = (count > 0) & (count < size)
    if short.any():
        first = np.concatenate(([0], np.cumsum(count)))[:-1]
        more, at = [], np.flatnonzero(short)
        for d in at:
            part = w.hash[first[d] : first[d] + count[d]]
            more.append(mix(part * U64(3) + np.arange(1, len(part) + 1, dtype=U64)).sum(dtype=U64))
        doc, h = np.concatenate((doc, at)), np.concatenate((h, mix(np.array(more, U64))))
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return doc, h


def shingle_numbers(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, number) of the distinct shingles of all texts, in order; numbers are equal exactly where the words are."""
    w = words(texts)
    number, n = word_numbers(w), len(w.hash) - size + 1
    good = np.flatnonzero(w.doc[:n] == w.doc[size - 1 :]) if n > 0 else np.zeros(0, np.int64)
    doc = w.doc[good]
    _, at, shingle = np.unique(grams(w, size)[good] if n > 0 else np.zeros(0, U64), return_index=True, return_inverse=True)
    rep, equal = good[at[shingle]], np.ones(len(good), bool)
    for k in range(size):
        equal &= number[good + k] == number[rep + k]
    known: dict[bytes, int] = {}
    name = lambda *words_: known.setdefault(np.array(words_).tobytes(), len(at) + len(known))
    for i in np.flatnonzero(~equal):  # equal hashes of different shingles
        shingle[i] = name(*number[good[i] : good[i] + size])
    count = w.per_doc()
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.cumsum(count) - count
        doc = np.concatenate((doc, short))
        shingle = np.concatenate((shingle, [name(*number[first[d] : first[d] + count[d]]) for d in short]))
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    return doc[new], shingle[new]


def shingle_sets(texts: pa.Array, size: int, lower: bool = True):
    """For each slice of texts: first row, row after the last, bounds of the rows' sets, the sorted distinct hashes."""
    for i, j in slices(texts):
        doc, h = shingle_hashes(words(texts[i:j], lower), size)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[new], h[new]
        yield i, j, np.searchsorted(doc, np.arange(j - i + 1)), h


def minima(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(documents with a shingle) x MINIMA minima of 32 bits."""
    first = bounds[:-1][np.diff(bounds) > 0]
    x = (h >> U64(32)).astype(np.uint32) ^ h.astype(np.uint32)
    out, t = np.empty((len(first), MINIMA), np.uint32), np.empty(len(x), np.uint32)
    for k in range(MINIMA if len(first) else 0):
        np.multiply(x, _A[k], out=t)
        np.add(t, _B[k], out=t)
        t ^= t >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(t, first)
    return out


def pack(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum; plane by plane, so that planes can be compared bytewise."""
    planes = [np.packbits((m >> np.uint32(b)) & np.uint32(1), axis=1) for b in range(BITS)]
    return np.concatenate(planes, axis=1).astype(np.uint8)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures, corrected for chance collisions of the low bits."""
    width = MINIMA // 8
    differ = a ^ b
    differ = differ.reshape(*differ.shape[:-1], BITS, width)
    differ = np.bitwise_or.reduce(differ, axis=-2)
    same = 1 - ONES[differ].sum(axis=-1, dtype=np.int64) / MINIMA
    chance = 2.0**-BITS
    return (same - chance) / (1 - chance)


def possible(threshold: float) -> float:
    """Estimates below this rule a pair out: six standard errors."""
    chance = 2.0**-BITS
    p = threshold + (1 - threshold) * chance
    return threshold - 6 * (p * (1 - p) / MINIMA) ** 0.5 / (1 - chance)


def rows_for(percent: int) -> int:
    """Rows a band; few enough that a pair at the threshold is missed less than once in a million."""
    return next((rows for rows in (6, 5, 4, 3, 2) if (1 - (percent / 100) ** rows) ** (MINIMA // rows) < 1e-6), 1)


def text_sha(text: Column) -> Column:
    return F.unhex(F.sha1(F.coalesce(text, F.lit("")).cast("binary")))


def signatures(docs: DataFrame, shingle: int, rows: int) -> DataFrame:
    """doc_id, sha (of the text), row (a number of its own), n (shingles), digest, sig, bands (keys made of ``rows`` minima each); digest, sig and bands null without shingles."""
    n_bands = MINIMA // rows

    def scan(batches):
        for batch in batches:
            texts = batch.column(1)
            for i, j, bounds, h in shingle_sets(texts, shingle):
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                m = minima(h, bounds)
                sig = pack(m)
                keys = np.empty((len(full), n_bands), U64)
                for b in range(n_bands):
                    k = np.full(len(full), b + 1, U64)
                    for c in m[:, b * rows : (b + 1) * rows].T:
                        k = mix(k * U64(0x9E3779B97F4A7C15) + c)
                    keys[:, b] = k
                digest, sigs, bands = ([None] * (j - i) for _ in range(3))
                for r, d in enumerate(full):
                    digest[d] = _digest(_plain(texts[i + int(d)]))
                    sigs[d], bands[d] = sig[r].tobytes(), keys[r].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(2)[i:j], pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "sha", "n", "digest", "sig", "bands"],
                )

    data = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_sha(F.col("text")).alias("sha"))
    return data.mapInArrow(scan, "doc_id long, sha binary, n long, digest binary, sig binary, bands array<long>").withColumn("row", F.monotonically_increasing_id())


_TO_LOWER = _LOWER.tobytes()


def _plain(text: pa.Scalar) -> bytes:
    """The words in lower case, joined by one space."""
    return b" ".join(text.as_buffer().to_pybytes().translate(_TO_LOWER).split())


def _digest(plain: bytes) -> bytes:
    return hashlib.blake2b(plain, digest_size=16).digest()


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, plain) of the classes of all documents with the wanted doc_ids: digest and words."""

    def scan(batches):
        for batch in batches:
            plain = [_plain(x) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in plain], pa.binary()), pa.array(plain, pa.binary())], ["id", "plain"])

    data = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return data.join(ids, "doc_id", "left_semi").mapInArrow(scan, "id binary, plain binary")


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets."""

    def scan(batches):
        for batch in batches:
            both = pa.concat_arrays([batch.column(2), batch.column(3)])
            order = pa.array(np.arange(2 * batch.num_rows).reshape(2, -1).T.ravel())
            both, keep = both.take(order), []  # the texts of a pair lie together
            for i, j in _pair_slices(both):
                doc, number = shingle_numbers(both[2 * i : 2 * j], shingle)
                n = np.bincount(doc, minlength=2 * (j - i)).reshape(-1, 2)
                of = doc >> 1
                at = np.lexsort((number, of))
                same_ = (of[at][1:] == of[at][:-1]) & (number[at][1:] == number[at][:-1])
                held = np.bincount(of[at][1:][same_], minlength=j - i)
                keep.append((100 * held >= percent * (n.sum(1) - held)) & (held > 0))
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    left, right = texts.select(F.col("id").alias("a"), F.col("plain").alias("ta")), texts.select(F.col("id").alias("b"), F.col("plain").alias("tb"))
    full = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return full.mapInArrow(scan, "a binary, b binary")


def _pair_slices(both: pa.Array, most: int = 1 << 21):
    """Ranges of pairs with about ``most`` bytes of text each; one pair at least."""
    _, at = text_bytes(both)
    i, n = 0, len(both) // 2
    while i < n:
        j = max(i + 1, (int(np.searchsorted(at, at[2 * i] + most, "right")) - 1) // 2)
        yield i, j
        i = j


def _likely(percent: int):
    """A filter of rows (a, b, sa, sb, na, nb) by size and estimate."""
    least = possible(percent / 100)

    def scan(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            na, nb = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            good = (estimated(a, b) >= least) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

    return scan


def _overlaps(owner: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
    """Sizes of all intersections of n sets, given as (set, element) in order of the set."""
    both = np.zeros((n, n), np.float32)
    _, column, times = np.unique(column, return_inverse=True, return_counts=True)
    owner, column = owner[times[column] > 1], column[times[column] > 1]
    if not len(column):
        return both
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for i in range(0, int(column[-1]) + 1, 4096):
        part = slice(*np.searchsorted(column, (i, i + 4096)))
        m = np.zeros((n, 4096), np.float32)
        m[owner[part], column[part] - i] = 1
        both += m @ m.T
    return both


def _field_links(percent: int, shingle: int):
    """Confirmed links between different components of each field: as many as join them, no more."""

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by([("field", "ascending"), ("id", "ascending")]).combine_chunks()
        ids, field, component = (table[c].to_pylist() for c in ("id", "field", "component"))
        texts = table["plain"].combine_chunks()
        at = [i for i in range(len(ids)) if not i or field[i] != field[i - 1]]
        a, b = [], []
        for i, j in zip(at, [*at[1:], len(ids)], strict=True):
            owner, number = shingle_numbers(texts[i:j], shingle)
            n = np.bincount(owner, minlength=j - i)
            both = _overlaps(owner, number, j - i).astype(np.int64)
            _, comp = np.unique(np.array(component[i:j], object), return_inverse=True)
            linked = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (both > 0)
            for x, y in zip(*np.nonzero(np.triu(linked & (comp[:, None] != comp[None, :]), 1)), strict=True):
                if comp[x] != comp[y]:
                    a.append(ids[i + x])
                    b.append(ids[i + y])
                    comp[comp == comp[y]] = comp[x]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return scan


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 3, block: int = 512, sha: bool = False) -> DataFrame:
    """Groups of documents linked by 100 * intersection >= percent * union of their shingle sets.

    Words are the texts' with A-Z in lower case. Returns one row for each input row:
    doc_id, n_shingles, component_id (smallest id reachable over links, itself
    included), kept (doc_id = component_id).

    Defined cases: null, empty and wordless texts have no shingles and are linked
    with nothing; a null id counts as the least id and comes back as null; rows that
    share an id have the links of their own texts, and of those in a group whose least id
    they share, one row is kept; a table without rows gives none; extra columns are ignored.
    With ``sha`` the SHA-1 of each row's text comes back, too.
    """
    rows = stored(signatures(docs, shingle, rows_for(percent)))
    full = rows.where("n > 0")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("held"))
    members = stored(
        full.join(classes.select(F.col("digest").alias("d"), "rep"), (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("rep")), "left_semi").dropDuplicates(["digest"]).select(F.col("digest").alias("id"), "doc_id", "n", "sig", "bands")
    )
    buckets = members.select("id", F.explode("bands").alias("band"))
    shared = stored(buckets.groupBy("band").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("held")).where("held > 1").select("band", "pivot"))
    held = buckets.join(shared, "band")
    stars = held.where("id != pivot").groupBy(F.col("id").alias("b")).agg(F.min("pivot").alias("a")).select("a", "b")
    ids = shared.select(F.col("pivot").alias("id")).union(held.select("id")).distinct()
    wanted = members.join(ids, "id", "left_semi").select("doc_id").distinct()
    texts = stored(_texts(docs, wanted).dropDuplicates(["id"]))
    sigs = members.select("id", "sig", "n")

    def likely(pairs: DataFrame) -> DataFrame:
        left, right = sigs.toDF("a", "sa", "na"), sigs.toDF("b", "sb", "nb")
        full_rows = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", "na", "nb")
        return full_rows.mapInArrow(_likely(percent), "a binary, b binary")

    links = stored(_confirm(likely(stars), texts, percent, shingle))
    found = components(links)
    labelled = held.join(found, "id", "left").select("band", "pivot", "id", F.coalesce("component", "id").alias("component"))
    open_bands = labelled.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("band")
    rest = stored(labelled.join(open_bands, "band").groupBy("id", "component").agg(F.array_distinct(F.collect_list("pivot")).alias("pivots")))
    least_pivot = F.array_min("pivots").alias("b")
    near = rest.select(F.col("id").alias("a"), least_pivot).union(rest.select(F.explode("pivots").alias("a"), least_pivot).distinct())
    # neighbours over open bands form a field; inside it, pairs are confirmed block by block
    fields = components(near)
    placed = rest.select("id", "component").join(fields.select("id", F.col("component").alias("field")), "id")
    sizes = placed.groupBy("field").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    bundles = pieces_for(rest.count(), 2 * block, shuffle_partitions(docs.sparkSession))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    blocks = placed.join(sizes, "field").withColumn("mine", mine)
    blocks = blocks.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    blocks = blocks.select(
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("field"), F.lit(bundles))).otherwise(F.xxhash64("field")).alias("bundle"),
        F.when(F.col("blocks") == 1, -1).otherwise(F.least("mine", "other")).alias("x"),
        F.when(F.col("blocks") == 1, -1).otherwise(F.greatest("mine", "other")).alias("y"),
        "field", "id", "component",
    )
    more = stored(blocks.join(texts, "id").groupBy("bundle", "x", "y").applyInArrow(_field_links(percent, shingle), "a binary, b binary"))
    if more.limit(1).count():
        found = components(links.unionByName(more))
    keyed = classes.withColumnRenamed("digest", "id")
    kept = keyed.join(found, "id").groupBy("component").agg(F.min("rep").alias("least"), F.min_by("id", F.struct("rep", "id")).alias("keeper"))
    named = stored(keyed.join(found.join(kept, "component"), "id", "left").select(F.col("id").alias("digest"), "held", F.coalesce("least", "rep").alias("component"), F.coalesce("keeper", "id").alias("keeper")))
    # classes with a thousandth of the rows and more, a thousand at most, meet their rows by broadcast
    least = (named.agg(F.sum("held")).first()[0] or 0) / 1000
    many = F.broadcast(named.where(F.col("held") >= least).drop("held"))
    # of rows that share the kept id and its set, the first stays
    again = full.groupBy("digest", "doc_id").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("again")).where("again > 1").select(F.col("digest").alias("_d"), F.col("doc_id").alias("_i"), "first")
    part = rows.select("doc_id", "sha", "row", "n", "digest")
    with_words = part.where("digest is not null")
    result = with_words.join(many, "digest").unionByName(with_words.join(many.select("digest"), "digest", "left_anti").join(named.drop("held"), "digest"))
    result = result.join(again, (F.col("digest") == F.col("_d")) & (F.col("doc_id") == F.col("_i")), "left").drop("_d", "_i")
    result = result.unionByName(part.where("digest is null"), allowMissingColumns=True)
    own = F.coalesce("component", "doc_id")
    return result.select(
        F.when(F.col("doc_id") != LEAST_ID, F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(own != LEAST_ID, own).alias("component_id"),
        ((own == F.col("doc_id")) & F.coalesce(F.col("digest") == F.col("keeper"), F.lit(True)) & F.coalesce(F.col("row") == F.col("first"), F.lit(True))).alias("kept"),
        *(["sha"] if sha else []),
    )
