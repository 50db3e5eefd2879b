"""SQL for DuckDB of those queries that SQL can express."""

from __future__ import annotations

from . import licenses


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def license_sql() -> str:
    """Phrases and templates by plain nested loops over words and windows."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    starts, names = [], []
    for i, (phrase, label) in enumerate(licenses.PHRASES):
        parts = phrase.split()
        match = " AND ".join(f"words[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
        starts.append(f"list_filter(range(0, greatest(len(words) - {len(parts) - 1}, 0)), lambda i: {match}) AS p{i}")
        names.append(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END")
    shares, more = [], []
    for i, (text, label) in enumerate(licenses.TEMPLATES):
        s = sorted(set(text.split()))
        need, window = licenses.least_words(text, licenses.THRESHOLD), licenses.block_length(text)
        best = f"list_max(list_transform(range(0, greatest(len(words), 1), {window // 2}), lambda i: len(list_intersect({_list(s)}, list_slice(words, i + 1, i + {window})))))"
        shares.append(f"CASE WHEN len(list_intersect({_list(s)}, words)) < {need} THEN NULL WHEN {best} >= {need} THEN {best} / {len(s)}::DOUBLE END AS t{i}")
        more.append(f"CASE WHEN t{i} IS NOT NULL THEN '{label}' END")
    n, p = len(licenses.TEMPLATES), len(licenses.PHRASES)
    distinct = lambda items: f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL))), ',')"
    every = "list_concat(" + ", ".join(f"p{i}" for i in range(p)) + ")" if p == 2 else f"flatten([{', '.join(f'p{i}' for i in range(p))}])"
    return rf"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
        ), f AS (SELECT *, {", ".join(starts)}, {", ".join(shares)} FROM w), g AS (SELECT *, {every} AS every FROM f)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, CAST(list_min(every) AS BIGINT) AS first_word, CAST(list_max(every) AS BIGINT) AS last_word,
               {distinct(names)} AS base_labels, {distinct([*names, *more])} AS labels,
               CASE WHEN len(every) > 0 THEN 1.0::DOUBLE ELSE coalesce(greatest({", ".join(f"t{i}" for i in range(n))}), 0.0::DOUBLE) END AS score
        FROM g"""


WARC = """
    WITH p AS (
        SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
    ), q AS (
        SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM p
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN keeper = page_id THEN NULL ELSE keeper END AS refers_to
    FROM q"""

TOP_K = """
    WITH v AS (
        SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
    ), r AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

ORACLES: dict[str, str] = {"op1_warc": WARC, "op6_topk": TOP_K, "op10_licenses": license_sql()}
