"""The operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import (
    q01_substring_dedup,
    q02_pii,
    q03_sentencepiece,
    q04_minhash,
    q05_toxicity,
    q06_packing,
    q07_knn_exact,
    q08_knn_forest,
    q09_warc,
    q10_sharding,
    q11_alignment,
    q12_filter_audit,
    q13_url_filter,
)

_MODULES = (
    q01_substring_dedup,
    q02_pii,
    q03_sentencepiece,
    q04_minhash,
    q05_toxicity,
    q06_packing,
    q07_knn_exact,
    q08_knn_forest,
    q09_warc,
    q10_sharding,
    q11_alignment,
    q12_filter_audit,
    q13_url_filter,
)
QUERIES = {m.NAME: m.query for m in _MODULES}
ORACLES = {m.NAME: m.SQL for m in _MODULES if m.SQL}
