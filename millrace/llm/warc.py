"""Deterministic sharded WARC archives.

Pages are cut into shards by ranges of their id, each of about ``shard_bytes`` of
payload, from an exact histogram of the ids, so the cuts depend on the pages alone.
Bins of the histogram that hold too much are cut again until they fit, so ids may
have gaps of any width. Each shard is one task; in it records are in order of their
id and files roll at ``file_bytes`` of compressed size. Every record is a gzip member
of its own, with digests and lengths made anew. Record ids are derived from the page's
id, its payload's digest and the number of earlier rows with both, dates are fixed, so
equal pages give equal files and no two records share an id. Pages without an id are
placed by a hash of payload and url instead, in shards of their own.

Ids, digests and lengths are stored once. The histogram and the verdict which pages
repeat a payload come from them; the verdict on an id and payload travels to the writer
as a row of its own that sorts just before their rows, so the pages are shuffled once. A file is
written under a temporary name, then renamed; what a task wrote is listed in a
manifest, which Spark commits with the job. A repeated attempt makes the same bytes
and leaves a file that is already there; files not in the manifest do not count.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored

DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("5f2b0f6e-8d0c-4b57-9a55-6a1d1f5a7c11")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(no_id: bool, key: int) -> str:
    """What record ids call a page: its id, or for none its place in the order."""
    return f"none-{key}" if no_id else str(key)


def record_id(page: str, digest: str, nth: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page} {digest} {nth}')}>"


def record(page: str, url: str | None, payload: bytes, refers_to: str | None, nth: int = 0) -> bytes:
    """A response record, or a revisit record of the page ``refers_to``; not compressed.

    Pages are given by ``_name``; ``nth`` counts the earlier records of the same page and payload.
    """
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    url = (url or f"urn:page:{page}").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page, digest, nth)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
    ]
    if not page.startswith("none"):
        head.append(f"X-Page-ID: {page}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        head += [] if refers_to.startswith("none") else [f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _Writer:
    """Files of one shard, rolled by compressed size."""

    def __init__(self, folder: str, shard: int, file_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.shard, self.most, self.seq, self.out = shard, file_bytes, 0, None

    def open(self) -> None:
        self.name, self.size, self.count, self.sha = f"{self.shard:06d}-{self.seq:05d}.warc.gz", 0, 0, hashlib.sha1()
        self.temporary = f"{self.root}/.{self.name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        info = b"software: millrace\r\nformat: WARC File Format 1.1\r\n"
        rid = f"<urn:uuid:{uuid.uuid5(_NAMESPACE, self.name)}>"
        self.put(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {rid}\r\nWARC-Date: {DATE}\r\nWARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")

    def put(self, data: bytes) -> None:
        member = gzip_member(data)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def add(self, data: bytes):
        """The finished file's manifest row, if this record filled it."""
        if self.out is None:
            self.open()
        self.put(data)
        self.count += 1
        return self.close() if self.size >= self.most else None

    def close(self):
        if self.out is None:
            return None
        self.out.close()
        final = f"{self.root}/{self.name}"
        there = self.fs.get_file_info(final)
        if there.type == pafs.FileType.File:  # an earlier attempt's
            if there.size == self.size and self._sha1(final) == self.sha.hexdigest():
                self.fs.delete_file(self.temporary)
                final = None
            else:
                self.fs.delete_file(final)
        if final:
            self.fs.move(self.temporary, final)
        row, self.out, self.seq = (self.shard, self.name, self.count, self.size, self.sha.hexdigest()), None, self.seq + 1
        return row


    def _sha1(self, path: str) -> str:
        with self.fs.open_input_stream(path, compression=None) as stream:
            return _Counted(stream).rest().sha.hexdigest()


class _Counted:
    """A stream that counts and digests what is read from it."""

    def __init__(self, stream):
        self.stream, self.size, self.sha = stream, 0, hashlib.sha1()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.size += len(data)
        self.sha.update(data)
        return data

    def rest(self) -> _Counted:
        while self.read(1 << 20):
            pass
        return self


MANIFEST = "shard int, file string, records long, bytes long, sha1 string"


def _cells(sizes: DataFrame, shard_bytes: int, bits: int) -> list[tuple[int, int, int]]:
    """(shift, id >> shift, bytes) of disjoint ranges of ids, each within a quarter of a shard or of one id.

    A pass over the ids makes at most 2**bits ranges; a further one cuts those that hold
    too much, as finely as the widest of them needs. What the driver gets grows with
    the number of shards, not of pages.
    """
    ends = sizes.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high")).first()
    if ends["low"] is None:
        return []
    shift, done, rest = max(0, (ends["high"] - ends["low"]).bit_length() - bits), [], sizes
    while True:
        key = F.shiftright("page_id", shift)
        found = rest.groupBy(key.alias("key")).agg(F.sum("size").alias("bytes"), F.min("page_id").alias("low"), F.max("page_id").alias("high")).collect()
        over = [r for r in found if shift and r["bytes"] > shard_bytes / 4]
        done += [(shift, r["key"], r["bytes"]) for r in found if not shift or r["bytes"] <= shard_bytes / 4]
        if not over:
            return done
        keys = sizes.sparkSession.createDataFrame([(r["key"],) for r in over], "key long")
        rest = rest.join(F.broadcast(keys), key == keys["key"], "left_semi")
        parts = 4 * max(r["bytes"] for r in over) // shard_bytes
        step = max(parts.bit_length() + 1, min(bits, 20 - len(over).bit_length()))
        shift = max(0, min(shift - 1, max((r["high"] - r["low"]).bit_length() for r in over) - step))


#: Leading bits of the payload's digest by which the rows of one large id are parted.
_SHA_BITS = 8


def _sha_part(sha: str = "sha"):
    return F.shiftright(F.conv(F.hex(F.substring(sha, 1, 2)), 16, 10).cast("int"), 16 - _SHA_BITS)


def _parted(marks: DataFrame, no_id: bool, cells: list[tuple[int, int, int]], shard_bytes: int) -> dict[int, dict[int, int]]:
    """Bytes by leading digest bits of each id that holds more than a quarter of a shard by itself."""
    large = [(key,) for shift, key, size in cells if not shift and size > shard_bytes / 4]
    if not large:
        return {}
    keys = marks.sparkSession.createDataFrame(large, "_k long")  # four a shard at most
    rows = marks.where(F.col("no_id") == no_id).join(F.broadcast(keys), F.col("key") == F.col("_k"), "left_semi")
    out: dict[int, dict[int, int]] = {}
    for r in rows.groupBy("key", _sha_part().alias("part")).agg(F.sum(F.col("n").cast("long") + 512).alias("bytes")).collect():
        out.setdefault(r["key"], {})[r["part"]] = r["bytes"]
    return out


def _with_shard(df: DataFrame, cells: dict[bool, list[tuple[int, int, int]]], large: dict[bool, dict[int, dict[int, int]]], shard_bytes: int) -> tuple[DataFrame, int]:
    """Adds the number of the shard: neighbouring cells together, as many as fit; pages with an id, then those without.

    The rows of a large id are parted by the leading bits of their payloads' digests.
    """
    found, shard = [F.lit(None).cast("int")], -1
    for no_id, ranges in cells.items():
        tables, parts, held = {}, [], 0
        shard += bool(ranges)
        for shift, key, whole in sorted(ranges, key=lambda c: c[1] << c[0]):
            by_part = {} if shift else large[no_id].get(key, {})
            for part, size in sorted(by_part.items()) or [(None, whole)]:
                if held and held + size > shard_bytes:
                    held, shard = 0, shard + 1
                held += size
                if part is None:
                    tables.setdefault(shift, []).append((key, shard))
                else:
                    parts.append((key, part, shard))
        if parts:
            table = df.sparkSession.createDataFrame(parts, f"_k{int(no_id)} long, _part{int(no_id)} int, _large{int(no_id)} int")
            df = df.join(F.broadcast(table), (F.col("no_id") == no_id) & (F.col("key") == F.col(f"_k{int(no_id)}")) & (_sha_part() == F.col(f"_part{int(no_id)}")), "left")
            found.append(F.col(f"_large{int(no_id)}"))
        for shift, rows in tables.items():
            name = f"{shift}_{int(no_id)}"
            table = df.sparkSession.createDataFrame(rows, f"_key{name} long, _shard{name} int")
            df = df.join(F.broadcast(table), (F.col("no_id") == no_id) & (F.shiftright("key", shift) == F.col(f"_key{name}")), "left")
            found.append(F.col(f"_shard{name}"))
    return df.withColumn("shard", F.coalesce(*found)), max(1, shard + 1)


def write(pages: DataFrame, folder: str, shard_bytes: int = 1 << 26, file_bytes: int = 1 << 25, least_payload: int = 0, bits: int = 14, most_shards: int = 1 << 14) -> DataFrame:
    """Writes the archives and their manifest below the new ``folder``; returns the manifest.

    Of pages with equal payloads of ``least_payload`` bytes or more, that with the
    smallest id is a response and the others revisit it. There are about ``most_shards``
    shards at most: with more than ``most_shards * shard_bytes`` of payload they grow beyond
    ``shard_bytes``, and so does a task, but not its memory nor its files. So the shuffle has a
    bounded number of partitions, and the driver a bounded number of ranges of ids.

    Defined cases: a null html is an empty payload, a null url a made-up one; rows with a
    null id have records without X-Page-ID and are a response only if no page with an id has
    their payload (refers_to is null in revisits of such a response; their WARC-Refers-To names
    it), and share a shard only if they share payload and url; of rows that share an id and payload
    one is a response and the others revisit that id; payloads of one id are told apart by
    digest, each a response or a revisit of its own; rows of one id lie in one shard or, where they
    hold more than a quarter of one, in neighbouring ones by digest, so only rows with the same id and payload must share a task;
    extra columns are ignored; no rows give an empty manifest.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    data = pages.select(F.col("page_id").cast("long").alias("key"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    data = data.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("no_id", F.col("key").isNull()).withColumn("key", F.coalesce("key", F.xxhash64("sha", "url")))
    marks = stored(data.select("no_id", "key", "sha", F.octet_length("payload").alias("n")))
    volume = marks.agg(F.sum(F.col("n").cast("long") + 512)).first()[0] or 0
    shard_bytes = max(shard_bytes, -(-volume // most_shards))
    sized = F.col("key").alias("page_id"), (F.col("n").cast("long") + 512).alias("size")
    cells = {no_id: _cells(marks.where(F.col("no_id") == no_id).select(*sized), shard_bytes, bits) for no_id in (False, True)}
    least = F.min(F.when(~F.col("no_id"), F.col("key")))
    first = marks.groupBy("sha", "n").agg(F.coalesce(least, F.min("key")).alias("first"), least.isNull().alias("first_no_id"), F.count(F.lit(1)).alias("held")).where(f"held > 1 and n >= {least_payload}")
    verdict = marks.join(first, ["sha", "n"]).select("no_id", "key", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "sha", "first", "first_no_id")
    verdict = verdict.dropDuplicates(["no_id", "key", "sha"]).withColumn("kind", F.lit(0))
    both = verdict.unionByName(data.withColumn("first", F.lit(None).cast("long")).withColumn("first_no_id", F.lit(None).cast("boolean")).withColumn("kind", F.lit(1)))
    large = {no_id: _parted(marks, no_id, found, shard_bytes) for no_id, found in cells.items()}
    both, n_shards = _with_shard(both, cells, large, shard_bytes)
    both = both.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("no_id", "key", "sha", "kind", "url")

    def scan(batches):
        writer, rows, at, first, nth = None, [], None, None, 0
        for batch in batches:
            for no_id, key, url, data_, sha, first_, first_no_id, kind, shard_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None or writer.shard != shard_:
                    rows.append(writer.close() if writer else None)
                    writer = _Writer(folder, shard_, file_bytes)
                page = _name(no_id, key)
                if (page, sha) != at:
                    at, first, nth = (page, sha), None, 0
                if kind == 0:
                    first = _name(first_no_id, first_)
                    continue
                again = first is not None and (first != page or nth)
                rows.append(writer.add(record(page, url, data_, first if again else None, nth)))
                nth += 1
            done, rows = [r for r in rows if r], []
            if done:
                yield table(done)
        if writer and (row := writer.close()):
            yield table([row])

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["shard", "file", "records", "bytes", "sha1"])

    manifest = both.select("no_id", "key", "url", "payload", "sha", "first", "first_no_id", "kind", "shard").mapInArrow(scan, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def records(stream):
    """(headers, block) of each record of an archive; reads a member at a time and raises where one is cut short."""
    inflate, text, data = zlib.decompressobj(31), io.BytesIO(), stream.read(1 << 20)
    begun = False
    while data:
        begun = True
        text.write(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            head, _, rest = text.getvalue().partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            size = int(headers["Content-Length"])
            if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
                raise ValueError(f"record {headers.get('WARC-Record-ID')} is not as long as it says")
            yield headers, rest[:size]
            inflate, text, begun = zlib.decompressobj(31), io.BytesIO(), False
        if not data:
            data = stream.read(1 << 20)
    if begun:
        raise ValueError("the archive ends inside a record")


def read(manifest: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The pages in the archives of the manifest, checked against it and their digests.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, and with
    ``payload`` the html of responses; page_id is null where the page's was. An archive whose
    records, bytes or SHA-1 are not those of the manifest raises, as does one that
    ends inside a record, and a payload that does not match its digest.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["html"] if payload else [])]

    def scan(batches):
        for batch in batches:
            for name, n_records, n_bytes, sha in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, root = pafs.FileSystem.from_uri(folder)
                rows, found = [[] for _ in names], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    stream = _Counted(stream)
                    for headers, block in records(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        found += 1
                        http, _, body = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if headers["WARC-Type"] == "response" and (len(body) != size or payload_digest(body) != digest):
                            raise ValueError(f"{name}: record {headers['WARC-Record-ID']} does not match its digest")
                        own, back = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                        values = [int(own) if own else None, size, digest, headers["WARC-Type"], int(back) if back else None, body.decode() if headers["WARC-Type"] == "response" else None]
                        for column, x in zip(rows, values, strict=False):
                            column.append(x)
                        if len(rows[0]) >= 2000:
                            yield out(rows)
                            rows = [[] for _ in names]
                    if (found, stream.size, stream.sha.hexdigest()) != (n_records, n_bytes, sha):
                        raise ValueError(f"{name} has {found} records and {stream.size} bytes, or another SHA-1, where the manifest has {n_records} and {n_bytes}")
                yield out(rows)

    def out(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=False)], names)

    files = manifest.select("file", "records", "bytes", "sha1").repartition(max(1, manifest.count()), "file")
    return files.mapInArrow(scan, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * payload)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages below the shared folder and reads the archives back."""
    folder = shared_dir(pages.sparkSession)
    folder = folder if "://" in folder else "file://" + folder
    return read(write(pages, folder), folder)
