"""Archives of pages whose ids are not unique."""

import pytest

from millrace.llm import warc


def heads(manifest, folder):
    """The headers of all records but the files' own."""
    out = []
    for r in manifest.collect():
        with open(f"{folder}/{r['file']}", "rb") as stream:
            out += [h for h, _ in warc.records(stream) if h["WARC-Type"] != "warcinfo"]
    return out


def test_payloads_of_one_id_are_told_apart(spark, tmp_path):
    rows = [(1, "a", "same"), (5, "b", "same"), (5, "c", "only"), (5, "d", "later"), (7, "e", "later"), (7, "f", "own"), (5, "g", "later"), (9, "h", "last")]
    manifest = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), tmp_path.as_uri())
    got = sorted((r["page_id"], r["record_type"], r["refers_to"] or 0, r["html"] or "") for r in warc.read(manifest, tmp_path.as_uri(), payload=True).collect())
    assert got == sorted([(1, "response", 0, "same"), (5, "revisit", 1, ""), (5, "response", 0, "only"), (5, "response", 0, "later"), (5, "revisit", 5, ""), (7, "revisit", 5, ""), (7, "response", 0, "own"), (9, "response", 0, "last")])
    found = heads(manifest, tmp_path)
    by_id = {h["WARC-Record-ID"]: h for h in found}
    assert len(by_id) == len(rows)
    for h in found:
        if h["WARC-Type"] == "revisit":
            to = by_id[h["WARC-Refers-To"]]
            assert (to["WARC-Type"], to["X-Page-ID"], to["WARC-Payload-Digest"]) == ("response", h["X-Refers-To-Page-ID"], h["WARC-Payload-Digest"])


def test_pages_without_an_id_are_kept(spark, tmp_path):
    rows = [(1, "a", "x" * 50), (None, "b", "x" * 50), (None, "c", "none"), (None, "d", "none"), (None, "d", "none"), (None, None, None), (-3, "e", "y" * 50), *[(None, f"u{i}", f"{i}" * 300) for i in range(100)]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    written = []
    for name in ("one", "two"):
        folder = tmp_path / name
        manifest = warc.write(pages.repartition(3) if name == "two" else pages, folder.as_uri(), shard_bytes=1 << 13)
        written.append(sorted(map(tuple, manifest.collect())))
    assert written[0] == written[1] and len(written[0]) > 4
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in warc.read(manifest, folder.as_uri()).collect())
    other = [(0, 4, "response", 0), (0, 4, "revisit", 0), (0, 4, "revisit", 0), (0, 0, "response", 0), (0, 50, "revisit", 1), (1, 50, "response", 0), (-3, 50, "response", 0)]
    assert got == sorted(other + [(0, 300 * len(str(i)), "response", 0) for i in range(100)])
    found = heads(manifest, folder)
    by_id = {h["WARC-Record-ID"]: h for h in found}
    assert len(by_id) == len(rows) and sorted(h["WARC-Target-URI"] for h in found if "b" <= h["WARC-Target-URI"] < "e") == ["b", "c", "d", "d"]
    assert all(by_id[h["WARC-Refers-To"]]["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] for h in found if h["WARC-Type"] == "revisit")


def test_archives_that_are_not_as_the_manifest_says_raise(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"{i}" * 3000) for i in range(30)], "page_id long, url string, html string")
    manifest = warc.write(pages, tmp_path.as_uri())
    (file,) = [r["file"] for r in manifest.collect()]
    whole = (tmp_path / file).read_bytes()
    member = whole.index(b"\x1f\x8b\x08", len(whole) * 2 // 3)  # the start of a record
    for broken in (whole[:member], whole[: member + 40], whole[:-3], whole + whole[member:], whole[:-5] + b"xxxxx", b""):
        (tmp_path / file).write_bytes(broken)
        with pytest.raises(Exception, match="manifest|inside a record|incorrect|Error"):
            warc.read(manifest, tmp_path.as_uri()).collect()
    (tmp_path / file).write_bytes(whole)
    assert warc.read(manifest, tmp_path.as_uri()).count() == 30


def test_a_file_of_an_earlier_attempt_is_taken_only_if_it_is_the_same(tmp_path):
    def made():
        w = warc._Writer(tmp_path.as_uri(), 0, 1 << 20)
        w.add(warc.record("1", "u", b"payload", None))
        return w.close()

    row = made()
    path = tmp_path / row[1]
    good = path.read_bytes()
    for found in (good, good[:-1], good[:-9] + b"123456789"):
        path.write_bytes(found)
        assert made() == row and path.read_bytes() == good
    assert [p.name for p in tmp_path.iterdir()] == [row[1]]


def test_shards_grow_where_there_would_be_too_many(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"{i}" * 3000) for i in range(60)], "page_id long, url string, html string")
    manifest = warc.write(pages, tmp_path.as_uri(), shard_bytes=1, most_shards=4)
    assert 1 < manifest.select("shard").distinct().count() <= 8
    assert warc.read(manifest, tmp_path.as_uri()).count() == 60


def test_rows_of_one_large_id_spread_over_shards(spark, tmp_path):
    rows = [(5, "u", f"{i % 60} " * 400) for i in range(120)] + [(None, "v", f"n{i}" * 600) for i in range(10)] + [(i, "w", f"{i} " * 400) for i in range(20)]
    written = []
    for name in ("one", "two"):
        folder = tmp_path / name
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2 + len(name))
        manifest = warc.write(pages, folder.as_uri(), shard_bytes=1 << 13)
        written.append(sorted(map(tuple, manifest.collect())))
    assert written[0] == written[1] and len({r[0] for r in written[0]}) > 15
    got = warc.read(manifest, folder.as_uri(), payload=True).collect()
    assert len(got) == len(rows) and len({h["WARC-Record-ID"] for h in heads(manifest, folder)}) == len(rows)
    first = {}
    for i, _, text in rows:
        first[text] = min(first.get(text, 10**9), 10**9 if i is None else i)
    for r in got:
        if r["record_type"] == "response" and r["page_id"] is not None:
            assert first[r["html"]] == r["page_id"]
    assert sum(r["record_type"] == "response" for r in got) == len(first)
