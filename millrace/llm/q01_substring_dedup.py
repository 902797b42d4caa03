"""Query op1: words left after repeated passages are removed from documents."""

from .common import read_table
from .substring_dedup import remove_repeats

NAME = "op1_substring_dedup"
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 18, 1))) AS t(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
cov AS (SELECT DISTINCT doc_id, i + j AS i FROM rep, unnest(range(0, 20)) AS t(j)),
word AS (SELECT doc_id, i, ws[i] AS x FROM w, unnest(range(1, len(ws) + 1)) AS t(i)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN cov USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def query(spark, sf_dir):
    found = remove_repeats(read_table(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
