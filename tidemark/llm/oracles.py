"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

URL_FILTERS = r"""
WITH rules(rule_verdict, rule_host, rule_path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
p AS (
  SELECT row_number() OVER () AS k, page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages),
hit AS (
  SELECT k, rule_host || rule_path AS rule, rule_verdict FROM p JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(rule_host || rule_path) DESC, rule_verdict DESC, rule_host || rule_path DESC) = 1)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM p LEFT JOIN hit USING (k)
"""

NEIGHBOURS = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.x, v.x) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def clusters(k: int = 8, rounds: int = 10) -> str:
    """Rounds one after the other, each as two tables: the centroids and the vectors' nearest."""
    parts = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        "cells AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM kept)",
        f"first AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM first)",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, min(struct_pack(s := s, c := c)) AS best FROM (SELECT r, c, sum((cells.x - c{i}.x) * (cells.x - c{i}.x)) AS s FROM cells JOIN c{i} USING (d) GROUP BY r, c) GROUP BY r)")
        if i < rounds:
            parts.append(f"m{i} AS (SELECT best.c AS c, d, sum(x) AS s, count(*) AS n FROM cells JOIN a{i} USING (r) GROUP BY 1, 2)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, d, coalesce((s - ((s % n + n) % n)) // n, x) AS x FROM c{i} LEFT JOIN m{i} USING (c, d))")
    parts.append(f"digests AS (SELECT c, sha256(string_agg(CAST(x AS BIGINT)::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(best.c AS INT) AS cluster, CAST(best.s AS BIGINT) AS distance, CAST(sum(best.s) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.s) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN digests ON digests.c = best.c"""


def manifest(levels: int = 6, crown: int = 4) -> str:
    """Level by level up to 16 ** levels rows a source and 16 ** crown sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 of an id's decimal text: each character enters, then eight shifts of the reflected polynomial
    items = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: list_concat([ascii(ch)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {items}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"
    parts = [
        f"leaves AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, source AS g, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(low)} END AS altered FROM documents)",
        "n0 AS MATERIALIZED (SELECT k, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM leaves)",
        "w0 AS MATERIALIZED (SELECT k, n0.g, i AS p, '' AS proof, coalesce(altered, leaf) AS fold FROM n0 JOIN leaves USING (k))",
    ]

    def climb(nodes: str, walk: str, count: int) -> tuple[str, str]:
        for t in range(count):
            parts.append(f"{nodes}r{t} AS MATERIALIZED (SELECT g, i // 16 AS j, string_agg(h, '' ORDER BY i) AS s FROM {nodes}{t} WHERE n > 1 GROUP BY 1, 2)")
            parts.append(f"{nodes}{t + 1} AS MATERIALIZED (SELECT g, j AS i, sha256(s) AS h, count(*) OVER (PARTITION BY g) AS n FROM {nodes}r{t} UNION ALL SELECT g, i, h, n FROM {nodes}{t} WHERE n = 1)")
            before, after = "substr(s, 1, (p % 16)::BIGINT * 64)", "substr(s, (p % 16)::BIGINT * 64 + 65)"
            parts.append(f"{walk}{t + 1} AS MATERIALIZED (SELECT k, w.g, CASE WHEN s IS NULL THEN p ELSE p // 16 END AS p, proof || coalesce({before} || {after}, '') AS proof, CASE WHEN s IS NULL THEN fold ELSE sha256({before} || fold || {after}) END AS fold FROM {walk}{t} w LEFT JOIN {nodes}r{t} r ON w.g IS NOT DISTINCT FROM r.g AND w.p // 16 = r.j)")
        return f"{nodes}{count}", f"{walk}{count}"

    subroots, walked = climb("n", "w", levels)
    parts.append(f"t0 AS MATERIALIZED (SELECT 0 AS g, g AS source, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n FROM {subroots})")
    parts.append(f"u0 AS MATERIALIZED (SELECT k, 0 AS g, i AS p, proof, fold FROM {walked} x JOIN t0 ON x.g IS NOT DISTINCT FROM t0.source)")
    root, done = climb("t", "u", crown)
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, t0.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = top.h AS verified
FROM leaves JOIN {done} USING (k) JOIN t0 ON leaves.g IS NOT DISTINCT FROM t0.source CROSS JOIN {root} top"""
