"""Every stage of the corpus pipeline against plain loops over what the stage before it kept."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import pii, toxicity
from millrace.llm.common import read_table, stored

P = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
STAGE_NAMES = ["toxicity", "near_dedup", "substring_dedup", "pii", "packing"]


@pytest.fixture(scope="module")
def outputs(spark):
    """Input of the first stage and output of each, by name."""
    docs = read_table(spark, SF, "documents")
    out = {"documents": docs}
    for name, stage in pipeline.STAGES:
        docs = out[name] = stored(stage(spark, docs, SF))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_and_columns(outputs):
    assert [name for name, _ in pipeline.STAGES] == STAGE_NAMES
    for name in STAGE_NAMES[:-1]:
        assert outputs[name].dtypes == outputs["documents"].dtypes


def test_toxicity(spark, outputs):
    before, after = rows(outputs["documents"]), rows(outputs["toxicity"])
    model = toxicity.train(outputs["documents"], read_table(spark, SF, "labels"))
    scores = toxicity.Machine.from_bytes(model).scores(pa.array([r["text"] for r in before.values()], pa.string()))
    assert after == {i: r for (i, r), s in zip(before.items(), scores, strict=True) if s < 0.5}


def test_near_copies(outputs):
    before, after = rows(outputs["toxicity"]), rows(outputs["near_dedup"])
    shingles = {}
    for i, r in before.items():
        words = WORD.findall((r["text"] or "").translate({c: c + 32 for c in range(65, 91)}))
        shingles[i] = {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(len(words), 1)))}
    group = {i: i for i in before}
    ids = sorted(before)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(shingles[a] & shingles[b])
            if both and 100 * both >= 80 * len(shingles[a] | shingles[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    assert after == {i: before[i] for i in ids if group[i] == i} and len(after) < len(before)


def test_repeated_passages(outputs):
    before, after = rows(outputs["near_dedup"]), rows(outputs["substring_dedup"])
    seen, want = set(), {}
    for i in sorted(before):
        words, cover = WORD.findall(before[i]["text"] or ""), set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                cover.update(range(k, k + 20))
            seen.add(window)
        if not cover:
            want[i] = before[i]["text"] or ""
        elif len(cover) < len(words):
            want[i] = " ".join(w for k, w in enumerate(words) if k not in cover)
    assert {i: r["text"] for i, r in after.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())


def test_personal_data(outputs):
    before, after = rows(outputs["substring_dedup"]), rows(outputs["pii"])
    assert before.keys() == after.keys()
    spans = {r["doc_id"]: r["pii"] for r in pii.find(outputs["substring_dedup"]).collect()}
    for i, r in before.items():
        text, at = "", 0
        for s in spans[i]:
            if s["start"] >= at:
                text += r["text"][at : s["start"]] + f"<{s['kind'].upper()}>"
            at = max(at, s["end"])
        assert after[i]["text"] == text + r["text"][at:]
        assert not re.search(r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", after[i]["text"])


def test_packing(spark, outputs):
    from tokenizers import Tokenizer

    before, pieces = rows(outputs["pii"]), outputs["packing"].collect()
    tokenizer, total, held = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, {}
    for p in pieces:
        held.setdefault(p["doc_id"], []).append(p)
    assert held.keys() == before.keys()
    for i, r in before.items():
        ids, at = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], 0
        for p in sorted(held[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
        total += at
    assert sorted(p["sequence_id"] * 4096 + p["offset"] + k for p in pieces for k in range(p["length"])) == list(range(total))
    assert pipeline.run(spark, SF).count() == len(pieces)


EXTRA = ["score", "pii", "_text", "_kept", "kept", "kept_text", "n_words", "n_removed", "chunk", "_id", "component_id", "length", "_extra", "spans"]


def test_odd_rows_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(60))
    values = [(0, text), (1, text), (1, text), (None, "mail a@b.co now"), (None, None), (2, None), (3, ""), (4, "word " * 30000), (5, "call +1 (555) 123-4567 now")]
    kind = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *[f"{c} string" for c in EXTRA]])
    odd = spark.createDataFrame([(*v, None, None, None, *[f"x{v[0]}"] * len(EXTRA)) for v in values], kind)
    for docs in (odd, odd.limit(0)):
        for name, stage in pipeline.STAGES[:-1]:
            out = stored(stage(spark, docs, SF))
            assert out.columns == docs.columns, name
            found = out.collect()
            assert all(r[c] == f"x{r['doc_id']}" for r in found for c in EXTRA), name
            docs = out
        last = pipeline.STAGES[-1][1](spark, docs, SF)
        assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in found}
    assert stored(pipeline.STAGES[3][1](spark, odd, SF)).where("text = 'call <PHONE> now' or text = 'mail <EMAIL> now'").count() == 2
