"""Registration of queries with their SQL, and pieces of SQL they share."""

from __future__ import annotations

from collections.abc import Callable

LANG = "CASE lower(trim({0})) WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'sh' THEN 'bash' WHEN 'shell' THEN 'bash' WHEN 'golang' THEN 'go' ELSE lower(trim({0})) END"
VERSIONS = (
    "v AS (SELECT symbol_version_id, max(symbol_id) AS symbol_id, max(snapshot_id) AS snapshot_id, max(file_id) AS file_id, max(range_start_line) AS range_start_line, max(range_end_line) AS range_end_line, max(signature) AS signature, max(ast_hash) AS ast_hash, max(body_hash) AS body_hash, "
    "max(normalized_ast_hash) AS normalized_ast_hash, max(summary) AS summary, max(body_source) AS body_source, max(visibility) AS visibility, max(" + LANG.format("language") + ") AS language, max(uncertainty_flags) AS uncertainty_flags FROM symbol_versions WHERE symbol_version_id IS NOT NULL GROUP BY 1)"
)
FILES = "f AS (SELECT file_id, snapshot_id, path, content_hash, " + LANG.format("language") + " AS language, parse_status FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY loaded_at DESC NULLS LAST, path DESC NULLS LAST, content_hash DESC NULLS LAST) rn FROM files WHERE file_id IS NOT NULL) WHERE rn = 1)"
SNAPSHOTS = (
    "sn AS (SELECT snapshot_id, repo_id, branch, parent_snapshot_id, created_at, indexed_at, lower(trim(index_status)) AS index_status, retained_until FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY indexed_at DESC NULLS LAST, repo_id DESC, branch DESC NULLS LAST, parent_snapshot_id DESC NULLS LAST, created_at DESC, "
    "lower(trim(index_status)) DESC NULLS LAST, retained_until DESC NULLS LAST) rn FROM snapshots WHERE snapshot_id IS NOT NULL) WHERE rn = 1)"
)
#: Versions with the time of their snapshot; steps between the distinct bodies of a symbol in the order of their first appearance.
TIMED = SNAPSHOTS + ", vt AS (SELECT v.*, coalesce(sn.created_at, TIMESTAMP '1970-01-01') AS t FROM v LEFT JOIN sn ON sn.snapshot_id = v.snapshot_id)"
IN_TIME = "(PARTITION BY symbol_id ORDER BY t, snapshot_id, symbol_version_id)"
BODY_STEPS = (
    SNAPSHOTS + ", fb AS (SELECT q.symbol_id, q.body_hash, min(struct_pack(t := coalesce(sn.created_at, TIMESTAMP '1970-01-01'), s := coalesce(q.snapshot_id, ''))) AS f FROM symbol_versions q LEFT JOIN sn ON sn.snapshot_id = q.snapshot_id WHERE q.body_hash IN (SELECT body_hash FROM {0}) GROUP BY 1, 2), "
    "st AS (SELECT symbol_id, body_hash AS b, lag(body_hash) OVER (PARTITION BY symbol_id ORDER BY f, body_hash) AS a FROM fb)"
)
COMMITS = "c AS (SELECT DISTINCT repo_id, hash, any_value(author_email) OVER w AS author, max(commit_date) OVER w AS commit_date, max(subject) OVER w AS subject FROM git_commits WHERE repo_id IS NOT NULL AND hash IS NOT NULL WINDOW w AS (PARTITION BY repo_id, hash))"
BODIES = "b AS (SELECT body_hash, max(body_source) AS body_source FROM symbol_versions WHERE body_hash IS NOT NULL AND body_source IS NOT NULL GROUP BY 1)"
EDGES = (
    "vn AS (SELECT v.symbol_version_id, v.snapshot_id, v.body_hash, s.canonical_name FROM v JOIN symbols s USING (symbol_id)), "
    "calls AS (SELECT body_hash, unnest(list_distinct(regexp_extract_all(body_source, '([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1))) AS callee FROM b), "
    "tg AS (SELECT snapshot_id, canonical_name AS callee, max(symbol_version_id) AS dst FROM vn GROUP BY 1, 2), "
    "e AS (SELECT DISTINCT vn.snapshot_id, vn.symbol_version_id AS src, tg.dst FROM vn JOIN calls USING (body_hash) JOIN tg ON tg.snapshot_id = vn.snapshot_id AND tg.callee = calls.callee WHERE vn.symbol_version_id <> tg.dst)"
)


class Registry:
    """Collects a module's queries: ``@r.query(sql)`` above f(spark, sf_dir)."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add
