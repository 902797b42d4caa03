"""Query op12: five filters over documents in all their orders."""

from .common import read_table
from .filter_audit import filter_audit

NAME = "op12_filter_audit"
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY x) AS low FROM t),
f AS (SELECT part, doc_id, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * len(regexp_replace(x, '[^A-Z]+', '', 'g')) > 5 * len(x),
    regexp_matches(x, '[#$%&*|]'), coalesce(low < doc_id, false)] AS fails FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
a AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [p.i, q.i, r.i, s.i, u.i] AS o FROM a p, a q, a r, a s, a u WHERE len(list_distinct([p.i, q.i, r.i, s.i, u.i])) = 5),
g AS (SELECT part, o, d.n, good, toxic, fails, list_position(list_transform(o, lambda k: fails[k]), true) AS gone FROM d, o),
c AS (SELECT part, o, step, o[step] AS flt, sum(CASE WHEN coalesce(gone, 9) > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails[o[step]] AND gone < step THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails[o[step]] AND len(list_filter(fails, lambda y: y)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
  CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, flt) AS BIGINT) AS shapley
FROM c
"""


def query(spark, sf_dir):
    return filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
