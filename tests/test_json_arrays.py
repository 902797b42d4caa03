"""Arrays read in splits against the plain parser."""

import json
import random

import pytest

from millrace.sources import json_arrays, payloads


@pytest.fixture
def small_splits(spark):
    """Splits of about 700 bytes."""
    sizes = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    yield
    for k in sizes:
        spark.conf.unset(k)


def made(r):
    nasty = ['"', "\\", "}", "{", "]", "[", "\\\\", '\\"}', "é漢", "\n", "},{", "a" * 50, ":"]
    text = lambda: "".join(r.choice(nasty) for _ in range(r.randint(0, 12)))
    return {"a": text(), "b": [text(), text()], "c": {"d": {"e": text()}, "f": []}, "n": r.randint(0, 9)}


SCHEMA = "a string, b array<string>, c struct<d:struct<e:string>,f:array<string>>, n int"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_arrays_in_many_splits(spark, tmp_path, small_splits, seed):
    r = random.Random(seed)
    files = [[made(r) for _ in range(n)] for n in (60, 0, 1, 17)] + [[{"a": "x}" * 2000, "n": 1}, {}, {"n": 2}]]
    for i, objects in enumerate(files):
        (tmp_path / f"f{i}.json").write_text(json.dumps(objects, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 2])), encoding="utf-8")
    (tmp_path / "empty.json").write_text("")
    found = json_arrays.read_objects(spark, str(tmp_path)).collect()
    by_file = {}
    for row in sorted(found, key=lambda x: x["at"]):
        by_file.setdefault(row["file"][-7:-5], []).append(json.loads(row["text"]))
    assert by_file == {f"f{i}": x for i, x in enumerate(files) if x}
    assert spark.read.text(str(tmp_path / "f0.json"), lineSep="}").rdd.getNumPartitions() > 8
    plain = spark.read.schema(SCHEMA).json(str(tmp_path), multiLine=True)
    assert sorted(map(str, json_arrays.read_array(spark, str(tmp_path), SCHEMA).collect())) == sorted(map(str, plain.collect()))


def test_feed_in_splits_is_the_feed(spark, tmp_path, small_splits):
    feed = [{"legal": "notice }"}] + [{"position": f"Dev {i} }}", "company": "A", "tags": ["python"], "url": f"https://x/{i}", "salary_min": 1000 * i, "salary_max": 90000} for i in range(80)]
    (tmp_path / "feed.json").write_text(json.dumps(feed))
    rows = payloads.read_feed(spark, str(tmp_path / "feed.json"), ["python"]).collect()
    assert sorted((r["title"], r["salary_raw"]) for r in rows) == sorted((f"Dev {i} }}", f"${1000 * i:,} - $90,000 per year" if i else "") for i in range(80))
