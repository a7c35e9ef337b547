"""DuckDB SQL that works schema facts out from the texts themselves, for the SQL twins of the queries.

Tokens come from one regular expression a dialect, whose matches tile the text
so that lengths add up to offsets. Statements, definitions and references are
windows and patterns over tokens. None of it shares code or data with the
package's own parser.
"""

from __future__ import annotations


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def files_sql(projects: dict[str, tuple[str, dict[str, str]]]) -> str:
    """``files(project, dialect, file, content)`` of ``{project: (dialect, {file: text})}``."""
    rows = [f"({literal(p)}, {literal(d)}, {literal(f)}, {literal(t)})" for p, (d, own) in projects.items() for f, t in own.items()]
    return "files(project, dialect, file, content) AS (VALUES " + ", ".join(rows) + ")"


_SPACE, _WORD, _ANY = r"\s+", "[A-Za-z0-9_]+", "."
_LINE, _BLOCK, _DOUBLE, _TICK = r"--[^\n]*", r"/\*.*?\*/", '"(?:""|[^"])*"', "`(?:``|[^`])*`"
_PLAIN = "'(?:''|[^'])*'"
#: Dollar quotes by tag, as the expression library has no back references.
_DOLLAR = [rf"\${tag}\$.*?\${tag}\$" for tag in ("", "fn", "body")]
TOKENS = {
    "postgres": [_SPACE, _LINE, _BLOCK, _PLAIN, _DOUBLE, *_DOLLAR, _WORD, _ANY],
    "mysql": [_SPACE, _LINE, r"#[^\n]*", _BLOCK, r"'(?:\\.|''|[^'\\])*'", _DOUBLE, _TICK, _WORD, _ANY],
    "sqlite": [_SPACE, _LINE, _BLOCK, _PLAIN, _DOUBLE, _TICK, r"\[[^\]]*\]", _WORD, _ANY],
}
_CASES = " ".join(f"WHEN '{d}' THEN regexp_extract_all(content, {literal('(?s)' + '|'.join(p))})" for d, p in TOKENS.items())

#: From ``files``: pieces of the text, tokens, statements, definitions, references, edges and what reaches what.
FACTS = rf"""
pieces AS (SELECT project, dialect, file, unnest(m) AS raw, generate_subscripts(m, 1) AS pos
  FROM (SELECT *, CASE dialect {_CASES} END AS m FROM files)),
placed AS (SELECT *, CAST(coalesce(sum(strlen(raw)) OVER w, 0) AS BIGINT) AS start, CAST(1 + coalesce(sum(strlen(raw) - strlen(replace(raw, chr(10), ''))) OVER w, 0) AS BIGINT) AS line,
    CASE WHEN regexp_full_match(raw, '\s+') THEN 'space'
      WHEN raw LIKE '--%' OR raw LIKE '/*%' OR (dialect = 'mysql' AND raw LIKE '#%') THEN 'comment'
      WHEN raw LIKE '''%' OR (dialect = 'postgres' AND raw LIKE '$%$%$') THEN 'string'
      WHEN raw LIKE '"%' OR (strlen(raw) > 1 AND left(raw, 1) IN ('`', '[')) THEN 'quoted'
      WHEN regexp_full_match(raw, '[A-Za-z0-9_]+') THEN 'word' ELSE 'punct' END AS kind
  FROM pieces WINDOW w AS (PARTITION BY project, file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
valued AS (SELECT *, CASE WHEN kind <> 'quoted' THEN raw WHEN raw LIKE '[%' THEN raw[2:-2]
      ELSE replace(raw[2:-2], left(raw, 1) || left(raw, 1), left(raw, 1)) END AS value,
    kind = 'punct' AND raw = ';' AS ends FROM placed WHERE kind <> 'space'),
folded AS (SELECT *, CASE WHEN kind = 'quoted' THEN value ELSE lower(value) END AS fold,
    coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY project, file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM valued),
body AS (SELECT *, dense_rank() OVER (PARTITION BY project, file ORDER BY part) - 1 AS stmt_idx,
    sum(CASE raw WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY project, file, part ORDER BY pos) AS depth
  FROM folded WHERE kind <> 'comment' AND NOT ends),
comments AS (SELECT c.project, c.file, c.pos, c.raw, c.dialect,
    (SELECT min(b.stmt_idx) FROM body b WHERE b.project = c.project AND b.file = c.file AND b.pos > c.pos) AS stmt_idx
  FROM folded c WHERE c.kind = 'comment'
    AND NOT EXISTS (SELECT 1 FROM body b WHERE b.project = c.project AND b.file = c.file AND b.part = c.part AND b.pos < c.pos)),
statements AS (SELECT project, dialect, file, stmt_idx, min(pos) AS first_at, min(start) AS start, max(start + strlen(raw)) AS stop,
    string_agg(fold, ' ' ORDER BY pos) AS words, coalesce(string_agg(fold, ' ' ORDER BY pos) FILTER (depth = 0), '') AS outer_words
  FROM body GROUP BY ALL),
forms AS (SELECT *, regexp_extract(words, '^create (?:or replace )?(?:unique )?(table|materialized view|view|index|function|procedure|trigger|type|sequence|extension) ', 1) AS form,
    regexp_matches(words, '^alter table ') AS alters FROM statements),
named AS (SELECT *, CASE WHEN alters THEN 'alter_table' WHEN form = '' THEN 'other' WHEN form = 'materialized view' THEN 'create_view'
      WHEN form = 'procedure' THEN 'create_function' ELSE 'create_' || form END AS kind,
    replace(CASE WHEN alters THEN regexp_extract(words, '^alter table (?:if exists )?(\S+(?: \. \S+)*)', 1)
      WHEN form = 'index' THEN regexp_extract(replace(words, ' on ', ' <on> '), ' index (?:if not exists )?([^<\s]\S*(?: \. \S+)*) <on> ', 1)
      WHEN form <> '' THEN regexp_extract(words, '^create (?:or replace )?(?:unique )?' || form || ' (?:if not exists )?(\S+(?: \. \S+)*)', 1)
      ELSE '' END, ' . ', '.') AS name FROM forms),
defs AS (SELECT * FROM named WHERE name <> ''),
found AS (SELECT project, file, stmt_idx, 'auto' AS ref_kind, 0 AS grp,
    CASE WHEN alters THEN list_prepend(name, regexp_extract_all(words, ' references (\S+(?: \. \S+)*)', 1))
      WHEN form = 'index' THEN regexp_extract_all(words, '^.*? on (\S+(?: \. \S+)*)', 1)
      WHEN form = 'trigger' THEN regexp_extract_all(words, '^.*? on (\S+(?: \. \S+)*)', 1)
      WHEN form IN ('function', 'procedure', 'type', 'sequence', 'extension', 'view', 'materialized view') THEN []
      ELSE regexp_extract_all(words, ' references (\S+(?: \. \S+)*)', 1) END AS names, name FROM named
  UNION ALL SELECT project, file, stmt_idx, 'view_scan', 0, regexp_extract_all(outer_words, ' (?:from|join) (\S+(?: \. \S+)*)', 1), '' FROM named WHERE kind = 'create_view'
  UNION ALL SELECT project, file, stmt_idx, 'directive', pos, string_split_regex(regexp_extract(raw, '^(?:--|#|/\*)\s*lineagrid:require\s+(.*?)\s*(?:\*/)?$', 1), '\s+'), '' FROM comments
    WHERE stmt_idx IS NOT NULL AND regexp_matches(raw, '^(?:--|#|/\*)\s*lineagrid:require\s')),
listed AS (SELECT project, file, stmt_idx, ref_kind, grp, replace(unnest(names), ' . ', '.') AS name, generate_subscripts(names, 1) AS k, name AS own FROM found),
kept AS (SELECT l.* FROM listed l JOIN named n USING (project, file, stmt_idx) WHERE l.name <> '' AND (l.own = '' OR n.kind <> 'create_table' OR l.name <> l.own)
    AND (n.kind <> 'alter_table' OR l.k = 1 OR l.name <> l.own)),
single AS (SELECT * FROM kept QUALIFY ref_kind = 'directive' OR row_number() OVER (PARTITION BY project, file, stmt_idx, ref_kind, name ORDER BY k) = 1),
refs AS (SELECT project, file, stmt_idx, ref_kind, CASE WHEN ref_kind = 'directive' THEN lower(name) ELSE name END AS name,
    row_number() OVER (PARTITION BY project, file, stmt_idx ORDER BY ref_kind = 'directive', grp, k) - 1 AS ref_ord FROM single),
edges AS (SELECT DISTINCT project, d.name AS "from", r.name AS "to",
    CASE WHEN ref_kind = 'view_scan' THEN 'view' WHEN ref_kind = 'directive' THEN 'directive'
      WHEN d.kind IN ('create_index', 'create_trigger') AND ref_ord = 0 THEN 'on' ELSE 'fk' END AS kind
  FROM refs r JOIN defs d USING (project, file, stmt_idx)
  WHERE r.name <> d.name AND (ref_kind <> 'view_scan' OR (project, r.name) IN (SELECT (project, name) FROM defs))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY project, name ORDER BY file, stmt_idx) AS rank FROM defs),
needs AS (SELECT DISTINCT r.project, r.file, r.stmt_idx, d.file AS dfile, d.stmt_idx AS didx FROM refs r
  JOIN (SELECT *, max(rank) OVER (PARTITION BY project, name) AS last FROM ranked) d ON d.project = r.project AND d.name = r.name AND d.rank = d.last
  WHERE NOT (r.file = d.file AND r.stmt_idx = d.stmt_idx)),
way(project, a, ai, b, bi) AS (SELECT project, file, stmt_idx, dfile, didx FROM needs
  UNION SELECT w.project, w.a, w.ai, n.dfile, n.didx FROM way w JOIN needs n ON n.project = w.project AND n.file = w.b AND n.stmt_idx = w.bi),
peers AS (SELECT DISTINCT w.project, s.name, t.name AS other FROM way w JOIN way v ON v.project = w.project AND v.a = w.b AND v.ai = w.bi AND v.b = w.a AND v.bi = w.ai
  JOIN named s ON s.project = w.project AND s.file = w.a AND s.stmt_idx = w.ai JOIN named t ON t.project = w.project AND t.file = w.b AND t.stmt_idx = w.bi
  WHERE s.name <> '' AND t.name <> ''),
reach(project, a, b) AS (SELECT project, "from", "to" FROM edges UNION SELECT r.project, r.a, e."to" FROM reach r JOIN edges e ON r.project = e.project AND r.b = e."from"),
nodes AS (SELECT project, name AS id, regexp_replace(regexp_replace(kind, '^(create|alter)_', ''), '^$', 'other') AS kind, file, false AS external FROM ranked WHERE rank = 1
  UNION ALL SELECT DISTINCT project, "to", 'unknown', '', true FROM edges WHERE (project, "to") NOT IN (SELECT (project, name) FROM defs))
"""


def facts_sql(projects: dict[str, tuple[str, dict[str, str]]]) -> str:
    return f"WITH RECURSIVE {files_sql(projects)}, {FACTS}"
