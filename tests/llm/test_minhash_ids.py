"""Near copies among rows whose ids are null or equal."""

from millrace.llm import minhash

A, B, C = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")


def test_rows_that_share_an_id_have_their_own_links(spark):
    rows = [(5, A), (5, B), (5, C), (7, A + " tail"), (8, B + " tail"), (9, C + " tail"), (None, "z " * 3 + A[::-1]), (None, B[::-1]), (3, B[::-1] + " tail"), (5, A), (5, B + " end"), (6, ""), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in minhash.near_duplicates(df, 85, 3).collect())
    want = [(5, 5, True), (5, 5, False), (5, 5, True), (5, 5, False), (5, 5, True), (7, 5, False), (8, 5, False), (9, 5, False), (-1, -1, True), (-1, -1, True), (3, -1, False), (6, 6, True), (6, 6, True)]
    assert got == sorted(want)


def test_pipeline_drops_copies_with_null_or_equal_ids(spark):
    import corpus_pipeline

    rows = [(None, A, 1), (None, A, 2), (None, A + " tail", 3), (4, B, 4), (4, B, 5), (4, B + " tail", 6), (4, C, 7), (9, C + " tail", 8), (None, "", 9), (None, "", 10), (None, None, 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int")
    got = corpus_pipeline.drop_near_copies(spark, df, "")
    assert got.columns == df.columns
    found = sorted((r["doc_id"] or 0, (r["text"] or "")[:2]) for r in got.collect())
    assert found == [(0, ""), (0, ""), (0, ""), (0, "a0"), (4, "b0"), (4, "c0")]
    assert {9, 10, 11} < {r["_id"] for r in got.collect()}
