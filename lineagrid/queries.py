"""Registered queries: schema analysis on a small tree (s_), and its kernels on tables (k_)."""

from __future__ import annotations

import io
import json
import os
import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.rpc import read_message, write_message
from .operators import catalog, diagnostics, editor, graphs, kernels, render, repair
from .oracles import facts_sql, files_sql
from .plans import projects
from .sources.files import discover, from_texts, read_tree, unix_lines
from .streaming import overlay

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- schema analysis -------------------------------------------------------

#: Three small trees, one for each dialect; SQL twins work their facts out from these texts.
FOREST: dict[str, tuple[str, dict[str, str]]] = {
    "harbour": ("postgres", {
        "a_piers.sql": "-- Where ships lie.\nCREATE TABLE piers (id serial PRIMARY KEY, chief int REFERENCES pilots(id), \"Old Note\" text DEFAULT 'it''s; fine');",
        "b_pilots.sql": (
            "CREATE TABLE IF NOT EXISTS pilots (id serial PRIMARY KEY, pier_id int NOT NULL REFERENCES piers(id) ON DELETE CASCADE,\n"
            "  vessel_id int, CONSTRAINT vessel_fk FOREIGN KEY (vessel_id) REFERENCES vessels(id));\n"
            "CREATE UNIQUE INDEX pilots_pier ON pilots (pier_id);;\nCREATE INDEX ON vessels (id);"
        ),
        "c_vessels.sql": (
            "/* hulls\n and engines */\nCREATE TABLE vessels (id serial PRIMARY KEY, kind vessel_kind, ghost_id int REFERENCES ghosts(id));\n"
            "CREATE TYPE vessel_kind AS ENUM ('a', 'b;c');\nALTER TABLE vessels ADD CONSTRAINT x FOREIGN KEY (kind) REFERENCES ghosts(id);"
        ),
        "d_code.sql": (
            "CREATE FUNCTION touch() RETURNS trigger AS $fn$ BEGIN; RETURN NEW; -- not a comment\nEND $fn$ LANGUAGE plpgsql;\n"
            "CREATE OR REPLACE PROCEDURE tidy() AS $$ SELECT 1; $$;\n"
            "CREATE TRIGGER piers_touch BEFORE UPDATE ON piers FOR EACH ROW EXECUTE FUNCTION touch();\n"
            "CREATE SEQUENCE IF NOT EXISTS berth_no;\nCREATE EXTENSION IF NOT EXISTS \"pg_trgm\";\nGRANT SELECT ON piers TO crew;\n-- the end"
        ),
        "e_views.sql": (
            "-- lineagrid:require vessel_kind pilots\n"
            "CREATE VIEW harbour.moorings AS SELECT p.id FROM pilots p JOIN vessels v ON v.id = p.vessel_id WHERE p.id IN (SELECT id FROM lost);\n"
            "CREATE MATERIALIZED VIEW \"Busy\" AS SELECT 1 FROM harbour.moorings JOIN nowhere ON true;"
        ),
    }),
    "clinic": ("mysql", {
        "a_wards.sql": "# wards of the house\nCREATE TABLE `Wards` (id int, `note` varchar(20) DEFAULT 'it\\'s; #1', head int, FOREIGN KEY (head) REFERENCES nurses(id));",
        "b_nurses.sql": (
            "CREATE TABLE nurses (id int, ward int, CONSTRAINT w FOREIGN KEY (ward) REFERENCES `Wards`(id));\n"
            "/* kept; for later */ -- and this\n;\nCREATE TABLE shifts (nurse int REFERENCES nurses (id));"
        ),
        "c_more.sql": (
            "CREATE VIEW roster AS SELECT * FROM nurses JOIN shifts;\n# lineagrid:require nurses, shifts\n"
            "CREATE TRIGGER t AFTER INSERT ON shifts FOR EACH ROW SET @a = 1; # done"
        ),
    }),
    "depot": ("sqlite", {
        "a_boxes.sql": "CREATE TABLE [boxes] (id integer, shelf integer REFERENCES shelves(id));",
        "b_shelves.sql": (
            "CREATE TABLE \"shelves\" (id integer, first integer REFERENCES boxes(id), [odd col] text);\n"
            "CREATE TABLE IF NOT EXISTS labels (box integer REFERENCES boxes(id), txt text DEFAULT 'x''y');\nCREATE TABLE boxes (again int);"
        ),
        "c_list.sql": "CREATE VIEW IF NOT EXISTS `Listing` AS SELECT * FROM boxes JOIN labels ON 1;",
    }),
}
_FACTS = facts_sql(FOREST)
#: Without the definitions that repeat a name: what can be bundled.
_BUNDLED = {p: (d, {f: t.replace("\nCREATE TABLE boxes (again int);", "") for f, t in own.items()}) for p, (d, own) in FOREST.items()}


def _files(spark: SparkSession, forest: dict[str, tuple[str, dict[str, str]]] = FOREST) -> DataFrame:
    found = [from_texts(spark, own, dialect, project) for project, (dialect, own) in forest.items()]
    return reduce(DataFrame.unionByName, found)


def _parsed(spark: SparkSession) -> DataFrame:
    return projects.parse(_files(spark))


@_query(
    _FACTS
    + """SELECT project, file, stmt_idx, CAST(row_number() OVER (PARTITION BY project, file, stmt_idx ORDER BY pos) AS INT) AS n, kind, raw, value,
  start - min(start) OVER (PARTITION BY project, file, stmt_idx) AS start FROM body"""
)
def s_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every dialect, comments apart: its kind, text, value and place in its statement."""
    found = catalog.tokens(_parsed(spark)).where("kind != 'comment'")
    n = F.row_number().over(Window.partitionBy("project", "file", "stmt_idx").orderBy("tok_idx"))
    return found.select("project", "file", F.col("stmt_idx").cast("bigint"), n.alias("n"), "kind", "raw", "value", F.col("start").cast("bigint"))


@_query(_FACTS + "SELECT project, kind, count(*) AS n FROM body GROUP BY ALL")
def s_tokens_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.tokens(_parsed(spark)).where("kind != 'comment'").groupBy("project", "kind").agg(F.count("*").alias("n"))


@_query(_FACTS + "SELECT project, file, stmt_idx, string_agg(raw, chr(10) ORDER BY pos) AS comments FROM comments WHERE stmt_idx IS NOT NULL GROUP BY ALL")
def s_leading_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments that belong to the statement after them, also over an empty one; those at the end are dropped."""
    found = catalog.statements(_parsed(spark)).where(F.size("comments") > 0)
    return found.select("project", "file", F.col("stmt_idx").cast("bigint"), F.array_join("comments", "\n").alias("comments"))


@_query(_FACTS + "SELECT project, file, stmt_idx, substring(content, CAST(start + 1 AS INT), CAST(stop - start AS INT)) AS text, start, stop FROM statements JOIN files USING (project, dialect, file)")
def s_statement_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.statements(_parsed(spark))
    return found.select("project", "file", F.col("stmt_idx").cast("bigint"), "text", F.col("start").cast("bigint"), F.col("end").cast("bigint").alias("stop"))


@_query(_FACTS + "SELECT project, file, stmt_idx, kind, name FROM named")
def s_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.statements(_parsed(spark)).select("project", "file", F.col("stmt_idx").cast("bigint"), "kind", "name")


@_query(_FACTS + "SELECT project, kind, count(*) AS n FROM named GROUP BY ALL")
def s_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.statements(_parsed(spark)).groupBy("project", "kind").agg(F.count("*").alias("n"))


@_query(_FACTS + "SELECT project, name, kind, file, rank FROM ranked")
def s_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.definitions(_parsed(spark)).select("project", "name", "kind", "file", F.col("rank").cast("bigint").alias("rank"))


@_query(_FACTS + "SELECT DISTINCT project, name FROM defs")
def s_definition_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.definition_names(_parsed(spark)).select("project", "name")


@_query(_FACTS + "SELECT project, file, stmt_idx, ref_ord, name, ref_kind FROM refs")
def s_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.references(_parsed(spark))
    return found.select("project", "file", F.col("stmt_idx").cast("bigint"), F.col("ref_ord").cast("bigint"), "name", "ref_kind")


@_query(_FACTS + "SELECT project, name, file, stmt_idx FROM ranked WHERE rank > 1")
def s_duplicate_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.definitions(_parsed(spark)).where("rank > 1").select("project", "name", "file", F.col("stmt_idx").cast("bigint"))


@_query(_FACTS + "SELECT project, file, stmt_idx, name FROM refs WHERE ref_kind <> 'view_scan' AND (project, name) NOT IN (SELECT (project, name) FROM defs)")
def s_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _parsed(spark)
    known = catalog.definitions(parsed).select("project", "name").distinct()
    refs = catalog.references(parsed).where("ref_kind != 'view_scan'")
    return refs.join(known, ["project", "name"], "left_anti").select("project", "file", F.col("stmt_idx").cast("bigint"), "name")


@_query(_FACTS + 'SELECT project, "from", "to", kind FROM edges')
def s_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.edges(_parsed(spark)).select("project", "from", "to", "kind")


@_query(_FACTS + 'SELECT project, "from", count(*) AS n FROM edges GROUP BY ALL')
def s_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.edges(_parsed(spark)).groupBy("project", "from").agg(F.count("*").alias("n"))


@_query(_FACTS + "SELECT project, id, kind, file, external FROM nodes")
def s_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.nodes(_parsed(spark)).select("project", "id", "kind", "file", "external")


@_query(_FACTS + "SELECT DISTINCT project, name FROM peers")
def s_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.components_by_project(_parsed(spark)).select("project", "name").distinct()


_IN_CYCLE = """, cyclic AS (SELECT e.*, EXISTS (SELECT 1 FROM peers p WHERE p.project = e.project AND p.name = e."from" AND p.other = e."to") AS in_cycle FROM edges e),
shown AS (SELECT n.*, EXISTS (SELECT 1 FROM peers p WHERE p.project = n.project AND p.name = n.id) AS in_cycle FROM nodes n)"""


@_query(_FACTS + _IN_CYCLE + ' SELECT project, "from", "to", kind, in_cycle FROM cyclic')
def s_export_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.exported(_parsed(spark))[1].select("project", "from", "to", "kind", "in_cycle")


@_query(_FACTS + _IN_CYCLE + " SELECT project, id, in_cycle FROM shown")
def s_export_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.exported(_parsed(spark))[0].select("project", "id", "in_cycle")


def _texts(spark: SparkSession, form: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    made = form(*graphs.exported(_parsed(spark)))
    lines = made.select("project", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.where("line != ''").select("project", F.col("n").cast("bigint"), "line")


_SHAPES_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in render.SHAPES.items()) + " ELSE 'box' END"


@_query(
    _FACTS
    + _IN_CYCLE
    + f""", lines AS (SELECT project, 2 AS part, id AS a, '' AS b, '' AS c, format('  "{{}}" [label="{{}}", shape={{}}{{}}{{}}];', id, id, {_SHAPES_SQL},
    CASE WHEN external THEN ', style="dashed"' ELSE '' END, CASE WHEN in_cycle THEN ', color="red"' ELSE '' END) AS line FROM shown
  UNION ALL SELECT project, 3, "from", "to", kind, format('  "{{}}" -> "{{}}" [label="{{}}", style={{}}{{}}];', "from", "to", kind,
    CASE WHEN kind IN ('view', 'directive') THEN 'dashed' WHEN kind = 'on' THEN 'dotted' ELSE 'solid' END, CASE WHEN in_cycle THEN ', color="red"' ELSE '' END) FROM cyclic
  UNION ALL SELECT DISTINCT project, 0, '', '', '', 'digraph dependencies {{' FROM files UNION ALL SELECT DISTINCT project, 1, '', '', '', '  rankdir=LR;' FROM files
  UNION ALL SELECT DISTINCT project, 4, '', '', '', '}}' FROM files)
SELECT project, row_number() OVER (PARTITION BY project ORDER BY part, a, b, c) - 1 AS n, line FROM lines"""
)
def s_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the Graphviz texts."""
    return _texts(spark, render.dot)


_SAFE = "'n_' || regexp_replace({0}, '[^A-Za-z0-9]', '_', 'g') || '_' || substr(sha1({0}), 1, 8)"


@_query(
    _FACTS
    + _IN_CYCLE
    + f""", numbered AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY "from", "to", kind) - 1 AS k FROM cyclic),
lines AS (SELECT project, 1 AS part, id AS a, '' AS b, '' AS c, 0 AS d, '  ' || {_SAFE.format('id')} || CASE WHEN external THEN '(((' || replace(id, '"', '#quot;') || ')))' ELSE '[' || replace(id, '"', '#quot;') || ']' END AS line FROM shown
  UNION ALL SELECT project, 1, id, '', '', 1, '  class ' || {_SAFE.format('id')} || ' cycle' FROM shown WHERE in_cycle
  UNION ALL SELECT project, 2, "from", "to", kind, 0, '  ' || {_SAFE.format('"from"')} || CASE WHEN kind = 'fk' OR kind = 'alter' THEN ' -->|' ELSE ' -.->|' END || kind || '| ' || {_SAFE.format('"to"')} FROM cyclic
  UNION ALL SELECT project, 4, '', '', '', k, '  linkStyle ' || k || ' stroke:#ff0000,stroke-width:2px' FROM numbered WHERE in_cycle
  UNION ALL SELECT DISTINCT project, 3, '', '', '', 0, '  classDef cycle stroke:#ff0000,stroke-width:2px' FROM files
  UNION ALL SELECT DISTINCT project, 0, '', '', '', 0, 'graph TD' FROM files)
SELECT project, row_number() OVER (PARTITION BY project ORDER BY part, a, b, c, d) - 1 AS n, line FROM lines"""
)
def s_mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the Mermaid texts."""
    return _texts(spark, render.mermaid)


@_query(
    _FACTS
    + _IN_CYCLE
    + """SELECT 'harbour' AS project, 'node' AS what, id AS "from", '' AS "to", kind, in_cycle, external FROM shown WHERE project = 'harbour'
UNION ALL SELECT 'harbour', 'edge', "from", "to", kind, in_cycle, false FROM cyclic WHERE project = 'harbour'"""
)
def s_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON text of one project, read back."""
    dialect, texts = FOREST["harbour"]
    held = json.loads(projects.graph(from_texts(spark, texts, dialect), "json"))
    rows = [("harbour", "node", n["id"], "", n["kind"], n.get("inCycle", False), n.get("external", False)) for n in held["nodes"]]
    rows += [("harbour", "edge", e["from"], e["to"], e["kind"], e["inCycle"], False) for e in held["edges"]]
    return spark.createDataFrame(rows, "project string, what string, `from` string, `to` string, kind string, in_cycle boolean, external boolean")


#: Statements of trees without repeated names after foreign keys within cycles have moved (or, in SQLite, are let be), in the smallest order.
_ORDERED = (
    facts_sql(_BUNDLED)
    + """, inner_needs AS (SELECT n.* FROM needs n WHERE EXISTS (SELECT 1 FROM way w WHERE w.project = n.project AND w.a = n.dfile AND w.ai = n.didx AND w.b = n.file AND w.bi = n.stmt_idx)),
moved AS (SELECT n.*, s.dialect, s.name, row_number() OVER (PARTITION BY n.project, n.file, n.stmt_idx ORDER BY r.ref_ord) AS sub FROM inner_needs n
  JOIN named s USING (project, file, stmt_idx) JOIN named t ON t.project = n.project AND t.file = n.dfile AND t.stmt_idx = n.didx
  JOIN refs r ON r.project = n.project AND r.file = n.file AND r.stmt_idx = n.stmt_idx AND r.name = t.name AND r.ref_kind = 'auto' WHERE s.dialect <> 'sqlite'),
pieces2 AS (SELECT project, file, stmt_idx, 0 AS sub, name, false AS synthesized FROM named UNION ALL SELECT project, file, stmt_idx, sub, name, true FROM moved),
key2 AS (SELECT *, format('{}|{:04d}|{:04d}', file, stmt_idx, sub) AS k FROM pieces2),
needs2 AS (SELECT project, file, stmt_idx, 0 AS sub, dfile, didx FROM (SELECT project, file, stmt_idx, dfile, didx FROM needs EXCEPT SELECT project, file, stmt_idx, dfile, didx FROM inner_needs)
  UNION SELECT project, file, stmt_idx, sub, dfile, didx FROM moved UNION SELECT project, file, stmt_idx, sub, file, stmt_idx FROM moved),
waits AS (SELECT k.project, k.k, k.file, k.stmt_idx, k.sub, k.name, k.synthesized, coalesce(list(format('{}|{:04d}|{:04d}', n.dfile, n.didx, 0)) FILTER (n.dfile IS NOT NULL), []) AS deps
  FROM key2 k LEFT JOIN needs2 n USING (project, file, stmt_idx, sub) GROUP BY ALL),
laid(project, place, done, k) AS (SELECT DISTINCT project, CAST(-1 AS BIGINT), CAST([] AS VARCHAR[]), '' FROM files
  UNION ALL SELECT p.project, any_value(p.place) + 1, list_append(any_value(p.done), min(w.k)), min(w.k) FROM laid p JOIN waits w
    ON w.project = p.project AND NOT list_contains(p.done, w.k) AND list_has_all(p.done, w.deps) GROUP BY p.project),
ordered AS (SELECT w.*, p.place FROM laid p JOIN waits w ON w.project = p.project AND w.k = p.k) """
)


def _fixed(spark: SparkSession) -> DataFrame:
    return repair.repaired(projects.parse(_files(spark, _BUNDLED)))


@_query(_ORDERED + "SELECT project, place, file, stmt_idx, sub, name, synthesized FROM ordered")
def s_topo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order after the foreign keys of cycles have moved; SQLite keeps them."""
    found = _fixed(spark)
    longs = [F.col(c).cast("bigint").alias(n) for c, n in (("place", "place"), ("stmt_idx", "stmt_idx"), ("sub_idx", "sub"))]
    return found.select("project", *longs, "file", "name", "synthesized")


@_query(_ORDERED + "SELECT project, file, name, count(*) AS n FROM ordered WHERE synthesized GROUP BY ALL")
def s_moved_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed(spark).where("synthesized").groupBy("project", "file", "name").agg(F.count("*").alias("n"))


@_query(
    _ORDERED
    + """, before AS (SELECT *, lag(file) OVER (PARTITION BY project ORDER BY place) AS last FROM ordered)
SELECT b.project, b.place, CASE WHEN last IS NULL OR last <> b.file THEN chr(10) || '-- source: ' || b.file || chr(10) ELSE chr(10) END
  || CASE WHEN synthesized THEN '-- fk constraint moved by lineagrid to break a dependency cycle (from ' || b.file || ')' || chr(10) ELSE '' END
  || coalesce((SELECT string_agg(c.raw || chr(10), '' ORDER BY c.pos) FROM comments c WHERE NOT synthesized AND c.project = b.project AND c.file = b.file AND c.stmt_idx = b.stmt_idx), '') AS head
FROM before b"""
)
def s_bundle_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What precedes each statement of the bundles: source lines, notes on moved keys, comments."""
    fixed = _fixed(spark)
    chunks = render.bundle_chunks(fixed).join(fixed.select("project", "place", "text"), ["project", "place"])
    head = F.expr("substring(chunk, 1, length(chunk) - length(text) - 2)")
    return chunks.select("project", F.col("place").cast("bigint"), head.alias("head"))


@_query(
    _ORDERED
    + """, whole AS (SELECT o.project, o.place, substring(content, CAST(start + 1 AS INT), CAST(stop - start AS INT)) AS text FROM ordered o
  JOIN statements s USING (project, file, stmt_idx) JOIN files f ON f.project = o.project AND f.file = o.file
  WHERE NOT synthesized AND NOT EXISTS (SELECT 1 FROM moved m WHERE m.project = o.project AND m.file = o.file AND m.stmt_idx = o.stmt_idx))
SELECT project, place, text || ';' || chr(10) AS tail FROM whole"""
)
def s_bundle_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of the bundles whose text stays as it was written."""
    fixed = _fixed(spark)
    changed = fixed.where("synthesized").select("project", "file", "stmt_idx").distinct()
    kept = fixed.where("not synthesized").join(changed, ["project", "file", "stmt_idx"], "left_anti").select("project", "place", "text")
    chunks = render.bundle_chunks(fixed).join(kept, ["project", "place"])
    return chunks.select("project", F.col("place").cast("bigint"), F.expr("right(chunk, length(text) + 2)").alias("tail"))


@_query(
    _FACTS
    + r""", tables AS (SELECT n.project, n.file, n.stmt_idx, n.name, substring(content, CAST(start + 1 AS INT), CAST(stop - start AS INT)) AS text FROM named n JOIN files USING (project, dialect, file) WHERE kind = 'create_table'),
clauses AS (SELECT project, file, stmt_idx, unnest(regexp_extract_all(text, '(?:CONSTRAINT \w+ )?FOREIGN KEY \([^)]*\) REFERENCES [`\w]+ ?\([^)]*\)|REFERENCES [`\w]+ ?\([^)]*\)(?: ON DELETE CASCADE)?')) AS clause, text FROM tables)
SELECT project, file, stmt_idx, clause NOT LIKE 'REFERENCES%' AS table_level,
  CASE WHEN clause LIKE 'REFERENCES%' THEN 'FOREIGN KEY (' || regexp_extract(replace(replace(text, clause, '<here>'), 'NOT NULL ', ''), '(\w+) \w+ <here>', 1) || ') ' || clause ELSE clause END AS add_sql FROM clauses"""
)
def s_fk_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair.foreign_key_clauses(_parsed(spark))
    return found.select("project", "file", F.col("stmt_idx").cast("bigint"), "table_level", "add_sql")


_LINED = r""", at_line AS (SELECT b.project, b.file, b.stmt_idx, b.pos, b.fold, b.start, b.line,
    b.start - coalesce((SELECT max(p.start + strlen(p.raw) - strpos(reverse(p.raw), chr(10)) + 1) FROM placed p WHERE p.project = b.project AND p.file = b.file AND p.pos < b.pos AND contains(p.raw, chr(10))), 0) + 1 AS col FROM body b),
joined AS (SELECT *, lead(fold) OVER w AS after FROM at_line WINDOW w AS (PARTITION BY project, file, stmt_idx ORDER BY pos)),
def_at AS (SELECT r.project, r.name, r.rank, r.kind, r.file, r.stmt_idx, min(j.pos) AS pos, arg_min(j.line, j.pos) AS line, arg_min(j.col, j.pos) AS col, arg_min(j.start, j.pos) AS start
  FROM ranked r JOIN at_line j ON j.project = r.project AND j.file = r.file AND j.stmt_idx = r.stmt_idx AND j.fold = split_part(r.name, '.', 1) AND j.pos > (SELECT min(pos) FROM body b WHERE b.project = r.project AND b.file = r.file AND b.stmt_idx = r.stmt_idx)
  GROUP BY ALL)"""


@_query(_FACTS + _LINED + " SELECT project, name, file, line, col FROM def_at")
def s_definition_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.definitions(_parsed(spark))
    return found.select("project", "name", "file", F.col("line").cast("bigint"), F.col("col").cast("bigint"))


@_query(
    _FACTS
    + _LINED
    + r""", missing AS (SELECT r.project, r.file, r.name, (SELECT min(j.pos) FROM joined j WHERE j.project = r.project AND j.file = r.file AND j.stmt_idx = r.stmt_idx AND j.fold = r.name
    AND EXISTS (SELECT 1 FROM body b WHERE b.project = r.project AND b.file = r.file AND b.stmt_idx = r.stmt_idx AND b.fold = 'references' AND b.pos < j.pos)) AS pos
  FROM refs r WHERE r.ref_kind = 'auto' AND (r.project, r.name) NOT IN (SELECT (project, name) FROM defs)),
twice AS (SELECT l.*, f.file AS first_file, f.line AS first_line, f.col AS first_col FROM def_at l JOIN def_at f ON f.project = l.project AND f.name = l.name AND f.rank = 1 WHERE l.rank > 1)
SELECT m.project, m.file || ':' || a.line || ':' || a.col || ': warning: unknown reference "' || m.name || '": not defined in this schema' AS line
  FROM missing m JOIN at_line a ON a.project = m.project AND a.file = m.file AND a.pos = m.pos
UNION ALL SELECT project, file || ':' || line || ':' || col || ': error: duplicate definition of "' || name || '": first defined at ' || first_file || ':' || first_line || ':' || first_col || ', redefined at ' || file || ':' || line || ':' || col FROM twice"""
)
def s_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong, but for what comments require, as lines."""
    found = diagnostics.lines(projects.check(_files(spark))).select("project", "line")
    return found.where(~F.col("line").contains("nurses,"))


@_query(_FACTS + "SELECT project, count(*) > 0 AS has_error FROM ranked WHERE rank > 1 GROUP BY project UNION ALL SELECT 'clinic', false")
def s_has_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.has_error(projects.check(_files(spark))).select("project", "has_error")


@_query(_FACTS + "SELECT project, min(name) AS name FROM ranked WHERE rank > 1 GROUP BY project")
def s_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first error that keeps a project from being bundled names the repeated definition."""
    found = projects.bundle(_files(spark)).where("error is not null")
    return found.select("project", F.regexp_extract("error", 'duplicate definition of "([^"]*)"', 1).alias("name"))


_MADE = {f"ring{n}": ("postgres", {f"{chr(97 + k)}.sql": f"CREATE VIEW v{k} AS SELECT 1 FROM v{(k + 1) % n};" for k in range(n)}) for n in (2, 3, 5)}


@_query(
    facts_sql(_MADE)
    + """, tour(project, k, path, pos) AS (SELECT DISTINCT project, 0, 'a.sql:v0', 'v0' FROM files
  UNION ALL SELECT t.project, k + 1, path || ' -> ' || d.file || ':' || d.name, d.name FROM tour t JOIN edges e ON e.project = t.project AND e."from" = t.pos JOIN defs d ON d.project = t.project AND d.name = e."to" WHERE k = 0 OR t.pos <> 'v0')
SELECT project, 'dependency cycle detected: ' || path AS message FROM tour WHERE k > 0 AND pos = 'v0'"""
)
def s_cycle_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of views cannot be split: the message walks the ring from its least file."""
    return projects.check(_files(spark, _MADE)).select("project", F.regexp_replace("message", r" \(.*", "").alias("message"))


@_query(_FACTS + f""", ids AS (SELECT DISTINCT id FROM nodes) SELECT id, {_SAFE.format('id')} AS node_id FROM ids""")
def s_mermaid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.nodes(_parsed(spark)).select("id", render.safe_id("id").alias("node_id")).distinct()


@_query(
    _FACTS
    + _LINED
    + """SELECT d.project || '/' || d.file || '/' || d.start AS request, d.name, f.file, f.line, f.col FROM def_at d JOIN def_at f ON f.project = d.project AND f.name = d.name AND f.rank = 1"""
)
def s_definition_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked at the first byte of each defined name: where the name is first defined."""
    parsed, files = _parsed(spark), _files(spark)
    at = catalog.definitions(parsed)
    asked = at.select(F.concat_ws("/", "project", "file", F.col("name_offset").cast("string")).alias("request"), "project", "file", F.col("name_offset").alias("offset"))
    found = editor.definition_of(asked, parsed, files)
    return found.select("request", "name", "file", F.col("line").cast("bigint"), F.col("col").cast("bigint"))


@_query(
    _FACTS
    + _LINED
    + """, asked AS (SELECT d.project || '/' || d.file || '/' || d.start AS request, d.project, d.name FROM def_at d)
SELECT a.request, f.file, coalesce((SELECT string_agg(c.raw || chr(10), '' ORDER BY c.pos) FROM comments c WHERE c.project = f.project AND c.file = f.file AND c.stmt_idx = f.stmt_idx), '')
  || substring(content, CAST(s.start + 1 AS INT), CAST(s.stop - s.start AS INT)) AS shown
FROM asked a JOIN ranked f ON f.project = a.project AND f.name = a.name AND f.rank = 1 JOIN statements s ON s.project = f.project AND s.file = f.file AND s.stmt_idx = f.stmt_idx
JOIN files t ON t.project = f.project AND t.file = f.file"""
)
def s_hover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement and the comments that an editor shows for each defined name."""
    parsed, files = _parsed(spark), _files(spark)
    at = catalog.definitions(parsed)
    asked = at.select(F.concat_ws("/", "project", "file", F.col("name_offset").cast("string")).alias("request"), "project", "file", F.col("name_offset").alias("offset"))
    return editor.hover(asked, parsed, files).select("request", "file", "shown")


_TYPED = {"references": "CREATE TABLE n (x int REFERENCES p", "directive": "-- lineagrid:require ", "on": "CREATE INDEX i ON v", "none": "SELECT p"}


@_query(
    facts_sql(FOREST)
    + """, typed(request, prefix) AS (VALUES ('references', 'p'), ('directive', ''), ('on', 'v'))
SELECT request, name AS label, replace(replace(kind, 'create_', ''), 'alter_', '') AS kind, file FROM typed JOIN ranked ON project = 'harbour' AND rank = 1
  AND starts_with(lower(name), prefix) AND (request = 'directive' OR kind = 'create_table')"""
)
def s_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names offered at the end of texts being typed."""
    dialect, texts = FOREST["harbour"]
    typed = {f"zz_{k}.sql": t for k, t in _TYPED.items()}
    files, known = from_texts(spark, texts | typed, dialect), projects.parse(from_texts(spark, texts, dialect))
    asked = spark.createDataFrame([(k, "", f"zz_{k}.sql", len(t)) for k, t in _TYPED.items()], "request string, project string, file string, offset int")
    found = editor.completions(asked, known, files)
    return found.select("request", "label", F.regexp_replace("kind", "^(create|alter)_", "").alias("kind"), "file")


@_query(_FACTS + "SELECT project, file, count(r.name) AS n FROM files LEFT JOIN (SELECT project, file, name FROM ranked WHERE rank > 1) r USING (project, file) GROUP BY ALL")
def s_open_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file, open in an editor, with the number of its errors: none included."""
    files = _files(spark)
    found = editor.open_files(files.select("project", "file"), projects.check(files).where("severity = 'error'"))
    return found.select("project", "file", F.size("diagnostics").cast("bigint").alias("n"))


@_query(f"WITH {files_sql(FOREST)} SELECT project, file, strlen(replace(content, 'e', chr(13) || chr(10))) - (strlen(content) - strlen(replace(content, 'e', ''))) AS size, content LIKE '%e%' AS split FROM files")
def s_unix_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose every e has become a line end of two bytes lose one of them."""
    texts = {f"{p}/{f}": t.replace("e", "\r\n") for p, (_, own) in FOREST.items() for f, t in own.items()}
    found = from_texts(spark, texts)
    place = F.split("file", "/")
    newline = F.contains(F.decode("content", "UTF-8"), F.lit("\n"))
    return found.select(place[0].alias("project"), place[1].alias("file"), F.octet_length("content").cast("bigint").alias("size"), newline.alias("split"))


@_query(f"WITH {files_sql(FOREST)} SELECT DISTINCT ON (project) project, CASE WHEN row_number() OVER (PARTITION BY project ORDER BY file) = 1 THEN file END AS file, 'new' AS content FROM files ORDER BY project, file")
def s_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each project the first file is opened and changed, the others opened and closed."""
    rows = []
    for p, (_, own) in FOREST.items():
        for k, f in enumerate(sorted(own)):
            rows += [(10 * k, p, f, "open", "old"), (10 * k + 1, p, f, "change" if k == 0 else "close", "new" if k == 0 else None)]
    found = overlay.latest(spark.createDataFrame(rows, overlay.EVENTS))
    return found.select("project", "file", F.decode("content", "UTF-8").alias("content"))


@_query(f"WITH {files_sql(FOREST)} SELECT project, file, strlen(content) AS size FROM files")
def s_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as framed messages and read back."""
    stream = io.BytesIO()
    for p, (_, own) in FOREST.items():
        for f, t in own.items():
            write_message(stream, {"project": p, "file": f, "text": t})
    stream.seek(0)
    rows = []
    while (m := read_message(stream)) is not None:
        rows.append((m["project"], m["file"], len(m["text"].encode())))
    return spark.createDataFrame(rows, "project string, file string, size bigint")


@_query(
    f"WITH {files_sql(FOREST)} SELECT project || '/' || file AS file, strlen(content) AS size, row_number() OVER (ORDER BY project || '/' || file) AS place FROM files"
)
def s_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of folders written and read: discovery, byte order, contents."""
    with tempfile.TemporaryDirectory() as folder:
        for p, (_, own) in FOREST.items():
            os.makedirs(os.path.join(folder, p, ".hidden"))
            for f, t in own.items():
                with open(os.path.join(folder, p, f), "w", encoding="utf-8") as out:
                    out.write(t)
            for extra in ("notes.txt", ".hidden/x.sql"):
                with open(os.path.join(folder, p, extra), "w", encoding="utf-8") as out:
                    out.write("SELECT 1")
        names = discover(folder)
        sizes = {r["file"]: r["n"] for r in read_tree(spark, folder, "postgres").select("file", F.octet_length("content").alias("n")).collect()}
    return spark.createDataFrame([(f, sizes[f], k + 1) for k, f in enumerate(names)], "file string, size bigint, place bigint")


# --- kernels on tables -----------------------------------------------------


@_query("""
SELECT o_orderkey AS order_id, c_name AS customer, count(*) AS item_count,
       CAST(sum(CAST(l_quantity * p_retailprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_orderkey, c_name""")
def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and money of each order, with its customer: lines are added up before orders are joined."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    names = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    money = (F.col("l_quantity") * F.col("p_retailprice")).cast("decimal(18,2)")
    sums = lines.join(parts, F.col("p_partkey") == F.col("l_partkey")).groupBy("l_orderkey")
    sums = sums.agg(F.count("*").alias("item_count"), F.sum(money).cast("double").alias("total"))
    found = orders.join(sums, F.col("l_orderkey") == F.col("o_orderkey")).join(names, F.col("c_custkey") == F.col("o_custkey"), "left")
    return found.select(F.col("o_orderkey").alias("order_id"), F.col("c_name").alias("customer"), "item_count", "total")


@_query("""SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) - 1 AS surplus FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def k_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.duplicated(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def k_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.unresolved(_table(spark, sf_dir, "orders").select("o_orderkey"), _table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


@_query("SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM labels) AS external FROM documents")
def k_external_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.flagged_external(_table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels"), "doc_id", "doc_id")


@_query("""SELECT user_id, event_type, event_id, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1""")
def k_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return kernels.first_wins(events, ["user_id", "event_type"], ["ts", "event_id"])


@_query("""SELECT conv_id, turn, role, sha256(text) AS text_sha256 FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1""")
def k_overlay_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    return kernels.last_wins(turns, ["conv_id"], ["turn"])


@_query("""SELECT u.user_id, count(e.event_id) AS n_errors FROM (SELECT DISTINCT user_id FROM events) u
  LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = 'error' GROUP BY u.user_id""")
def k_open_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user with the number of error events, none included: one pass without a join."""
    events = _table(spark, sf_dir, "events").select("user_id", "event_type")
    return events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n_errors"))


_TRADE = """WITH RECURSIVE trade AS (
  SELECT c_nationkey AS f, s_nationkey AS t, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"""


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by nation of customer and supplier; small sides are joined first, then summed."""
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("c_custkey") == F.col("o_custkey"))
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    found = lines.join(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    found = found.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return found.groupBy(F.col("c_nationkey").alias("from"), F.col("s_nationkey").alias("to")).agg(F.count("*").alias("n"))


def _best_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("from").orderBy(F.desc("n"), "to")
    return _trade(spark, sf_dir).where("from != to").withColumn("k", F.row_number().over(order)).where("k = 1").select("from", "to")


@_query(_TRADE + 'SELECT DISTINCT f AS "from", t AS "to" FROM trade WHERE f <> t')
def k_edges_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.distinct_edges(_trade(spark, sf_dir), "from", "to")


@_query(_TRADE + 'SELECT t AS "to", count(*) AS in_degree FROM trade WHERE f <> t GROUP BY t')
def k_indegree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.in_degrees(kernels.distinct_edges(_trade(spark, sf_dir), "from", "to"))


@_query(
    _TRADE
    + """, best AS (SELECT f, t FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY n DESC, t) AS k FROM trade WHERE f <> t) WHERE k = 1),
reach(a, b) AS (SELECT f, t FROM best UNION SELECT a, t FROM reach JOIN best ON b = f)
SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a"""
)
def k_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.cycle_members(_best_trade(spark, sf_dir))


@_query(
    _TRADE
    + """, e AS (SELECT f, t FROM trade WHERE f < t), nodes AS (SELECT f AS node FROM trade UNION SELECT t FROM trade),
up(node, level) AS (SELECT node, 0 FROM nodes UNION SELECT f, level + 1 FROM e JOIN up ON t = node)
SELECT node, max(level) AS level FROM up GROUP BY node"""
)
def k_topo_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the trade from nations with smaller keys to those with larger ones, which has no cycle; tables are read once."""
    trade = kernels.kept(_trade(spark, sf_dir).select("from", "to"))
    nations = trade.select(F.col("from").alias("node")).union(trade.select("to")).distinct()
    return kernels.levels(kernels.distinct_edges(trade, "from", "to").where("from < to"), nations)


@_query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'alter' WHEN k = 1 THEN 'on' ELSE 'fk' END AS edge_kind FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)""")
def k_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    nth = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    kind = F.when(F.col("event_type") == "error", "alter").when(nth == 1, "on").otherwise("fk")
    return events.select("event_id", kind.alias("edge_kind"))


_LINES = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
lines AS (SELECT doc_id, line_no, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, strlen(line) AS length FROM l)"""


@_query(_LINES + "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(start AS BIGINT) AS start, length FROM lines")
def k_linemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.line_starts(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@_query(
    _LINES
    + """, p AS (SELECT doc_id, CAST(floor(strlen(text) / 2) AS BIGINT) AS "offset" FROM documents)
SELECT p.doc_id, p."offset", CAST(line_no AS INTEGER) AS line_no FROM p JOIN lines l ON p.doc_id = l.doc_id AND p."offset" >= start AND p."offset" < start + length"""
)
def k_span_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that holds the middle byte of each document: a range join within each document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    middle = docs.select("doc_id", F.floor(F.octet_length("text") / 2).cast("bigint").alias("offset"))
    return kernels.spans_at(kernels.line_starts(docs, "doc_id", "text"), middle, "doc_id").select("doc_id", "offset", "line_no")


@_query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS n_words FROM documents")
def k_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", kernels.word_count("text").cast("bigint").alias("n_words"))


@_query("""SELECT p_partkey, lower(p_name) AS folded, p_brand AS kept FROM part""")
def k_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    part = part.withColumn("q", F.concat(F.lit('"'), "p_brand", F.lit('"')))
    return part.select("p_partkey", kernels.folded("p_name").alias("folded"), kernels.folded("q").alias("kept"))


@_query("SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), lower('RED W'))")
def k_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return part.where(F.lower("p_name").startswith("red w"))


@_query("SELECT doc_id, length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS units FROM documents")
def k_utf16_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", kernels.utf16_length("text").cast("bigint").alias("units"))


@_query("""SELECT n_name AS name, 'n_' || regexp_replace(n_name, '[^A-Za-z0-9]', '_', 'g') || '_' || substr(sha1(n_name), 1, 8) AS id FROM nation""")
def k_safe_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), render.safe_id("n_name").alias("id"))


@_query("SELECT doc_id, strlen(replace(replace(text, 'e', chr(13) || chr(10)), chr(13) || chr(10), chr(10))) AS size FROM documents")
def k_crlf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a table whose every e has become a line end of two bytes, with line ends of one."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("e"), F.lit("\r\n")).cast("binary").alias("content"))
    return unix_lines(docs).select("doc_id", F.octet_length("content").cast("bigint").alias("size"))


@_query("""SELECT p_partkey, regexp_replace('x"' || p_name || chr(92) || '"', '(["' || chr(92) || chr(92) || '])', chr(92) || chr(92) || chr(92) || '1', 'g') AS inner_text,
  p_name AS name FROM part""")
def k_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in double quotes as graphs and messages write them: quotes and backslashes escaped."""
    part = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    odd = part.withColumn("odd", F.concat(F.lit('x"'), "name", F.lit('\\"')))
    odd = odd.withColumn("q", diagnostics.quoted("odd"))
    return odd.select("p_partkey", F.expr("substring(q, 2, length(q) - 2)").alias("inner_text"), "name")


@_query("""SELECT o_orderkey, o_orderkey % 97 + 1 AS line, 1 + floor(o_custkey / 10) AS col,
  'orders/' || o_orderkey || '.sql:' || (o_orderkey % 97 + 1) || ':' || CAST(1 + floor(o_custkey / 10) AS BIGINT) || ': warning: w' AS shown FROM orders""")
def k_diagnostic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions as tools print them, for a table of any size."""
    rows = _table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit("p").alias("project"), F.format_string("orders/%d.sql", "o_orderkey").alias("file"),
        (F.col("o_orderkey") % 97 + 1).alias("line"), (1 + F.floor(F.col("o_custkey") / 10)).alias("col"),
        F.lit("warning").alias("severity"), F.lit("w").alias("message"),
    )
    shown = diagnostics.lines(rows.select("project", "file", "line", "col", "severity", "message")).select(F.col("line").alias("shown"))
    key = F.regexp_extract("shown", r"orders/(\d+)\.sql", 1).cast("bigint").alias("o_orderkey")
    return shown.select(key, "shown").join(rows.select("o_orderkey", "line", F.col("col").cast("double").alias("col")), "o_orderkey")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
