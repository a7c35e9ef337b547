"""Splitting dependency cycles that consist of foreign keys.

Postgres and MySQL: every foreign key within a component moves to an ALTER
TABLE after both tables. SQLite resolves foreign keys late, so the edges are
dropped and texts stay. A cycle with any other edge remains an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.foreign_keys import alter_statements
from ..functions.lexing import split
from ..functions.statements import AUTO, facts
from .graphs import Node, cycle_message, cycle_path, smallest_order, strong_components

#: A fixed value: the sentence that ends the message of such a cycle.
UNSPLITTABLE = (
    "a foreign key in this cycle could not be split automatically; "
    "move it to a table-level CONSTRAINT ... FOREIGN KEY clause or an explicit ALTER TABLE"
)


@dataclass(frozen=True)
class Piece:
    """A statement of a project as the repair sees it."""

    file: str
    index: int
    sub: int
    kind: str
    name: str
    text: str
    comments: tuple[str, ...] = ()
    refs: tuple[tuple[str, str], ...] = ()  # (name, reference kind)
    deps: tuple[str, ...] = ()
    synthesized: bool = False

    def node(self) -> Node:
        """Synthesized statements define nothing, so they never stand in for their table."""
        return Node(self.file, self.index, self.sub, "" if self.synthesized else self.name, self.deps)


@dataclass
class Repaired:
    pieces: list[Piece]
    order: list[int] = field(default_factory=list)
    error: str = ""
    first: Node | None = None


def _parsed(text: str, like: Piece, dialect: str, **changes) -> Piece:
    """A piece for generated text, parsed as if it had been written."""
    found = split(text.encode().decode("latin-1"), dialect)
    if len(found) != 1:
        raise ValueError(f"generated text is not one statement: {text!r}")
    own = facts(found[0])
    utf8 = lambda s: s.encode("latin-1").decode("utf-8", "replace")
    refs = tuple((utf8(r.name), r.kind) for r in own.refs)
    deps = tuple(dict.fromkeys(n for n, _ in refs))
    return replace(like, kind=own.kind, name=utf8(own.name), text=utf8(found[0].text), refs=refs, deps=deps, **changes)


def _inner(pieces: Sequence[Piece], group: Sequence[int]) -> dict[int, list[tuple[str, str]]]:
    """References of each member that stay within the component."""
    named = {p.node().name: k for k, p in enumerate(pieces) if p.node().name}
    members = set(group)
    return {k: [(n, kind) for n, kind in pieces[k].refs if named.get(n) in members - {k}] for k in group}


def _split_component(pieces: list[Piece], group: Sequence[int], dialect: str, strict: bool) -> tuple[list[Piece], str | None]:
    """The pieces after splitting one component, or a note why it cannot be split (None: not only foreign keys)."""
    inner = _inner(pieces, group)
    if any(pieces[k].kind != "create_table" or kind != AUTO for k, refs in inner.items() for _, kind in refs):
        return pieces, ""
    out, added = list(pieces), []
    for k in group:
        piece, targets = pieces[k], {n for n, _ in inner[k]}
        if dialect == "sqlite":
            out[k] = replace(piece, deps=tuple(d for d in piece.deps if d not in targets))
            continue
        text = piece.text.encode().decode("latin-1")
        made = alter_statements(text, dialect, targets, strict)
        if made is None:
            return pieces, UNSPLITTABLE
        back = lambda s: s.encode("latin-1").decode("utf-8", "replace")
        if made[1]:
            out[k] = _parsed(back(made[0]), piece, dialect)
        for n, statement in enumerate(made[1]):
            added.append(_parsed(back(statement), piece, dialect, sub=n + 1, comments=(), synthesized=True))
    if dialect != "sqlite" and not added:
        return pieces, UNSPLITTABLE
    return out + added, None


def repair(pieces: Sequence[Piece], dialect: str, strict: bool = False) -> Repaired:
    """Split all foreign-key cycles of a project and order what results."""
    held = list(pieces)
    nodes = [p.node() for p in held]
    for group in strong_components(nodes):
        held, note = _split_component(held, group, dialect, strict)
        if note is not None:
            own = [nodes[k] for k in group]
            path = cycle_path(own, smallest_order(own)[1])
            return Repaired(list(pieces), [], cycle_message(own, path, note), own[path[0]])
    nodes = [p.node() for p in held]
    order, left = smallest_order(nodes)
    if left:
        path = cycle_path(nodes, left)
        return Repaired(list(pieces), [], cycle_message(nodes, path), nodes[path[0]])
    return Repaired(held, order)


REPAIRED = (
    "project string, place int, file string, stmt_idx int, sub_idx int, kind string, name string, text string, "
    "comments array<string>, synthesized boolean, error string, error_name string"
)


def repaired(parsed: DataFrame, strict: bool = False) -> DataFrame:
    """The ordered statements of each project after repair, or one row with ``error``.

    Runs once for each project on its parsed statements; files with lex errors
    have none.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        columns = [f.split(" ")[0] for f in REPAIRED.split(", ")]
        frame = frame.sort_values(["file", "stmt_idx"], key=lambda c: c.str.encode("utf-8") if c.dtype == object else c)
        pieces = []
        for r in frame.itertuples(index=False):
            refs = tuple((x["name"], x["ref_kind"]) for x in r.refs)
            deps = tuple(dict.fromkeys(n for n, _ in refs))
            pieces.append(Piece(r.file, int(r.stmt_idx), 0, r.kind, r.name, r.text, tuple(r.comments), refs, deps))
        project = frame["project"].iloc[0]
        found = repair(pieces, frame["dialect"].iloc[0], strict)
        if found.error:
            rows = [(project, -1, found.first.file, -1, 0, "", "", "", [], False, found.error, found.first.name)]
        else:
            order = [found.pieces[k] for k in found.order]
            rows = [
                (project, n, p.file, p.index, p.sub, p.kind, p.name, p.text, list(p.comments), p.synthesized, None, None)
                for n, p in enumerate(order)
            ]
        return pd.DataFrame(rows, columns=columns)

    rows = parsed.where("error is null").select("project", "dialect", "file", "stmt_idx", "kind", "name", "text", "comments", "refs")
    return rows.groupBy("project").applyInPandas(run, REPAIRED)


def cycles(fixed: DataFrame, defined: DataFrame) -> DataFrame:
    """``project, file, line, col, message`` of unsplittable cycles, placed at the first node's definition."""
    first = defined.where("rank = 1").select("project", F.col("name").alias("error_name"), F.col("file").alias("_file"), "line", "col")
    found = fixed.where("error is not null").join(first, ["project", "error_name"], "left")
    return found.select(
        "project",
        F.coalesce("_file", "file").alias("file"),
        F.coalesce("line", F.lit(1)).alias("line"),
        F.coalesce("col", F.lit(1)).alias("col"),
        F.col("error").alias("message"),
    )


def foreign_key_clauses(parsed: DataFrame) -> DataFrame:
    """All clauses of CREATE TABLE statements: table_level, column, target, add_sql and span; refused ones have none."""
    from ..functions.foreign_keys import extract

    schema = (
        "project string, file string, stmt_idx int, table_level boolean, column string, target string, add_sql string, "
        "clause_start int, clause_end int"
    )

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                view = r.text.encode().decode("latin-1")
                own = split(view, r.dialect)
                for c in (extract(own[0].text, own[0].tokens) if len(own) == 1 else None) or []:
                    rows.append((r.project, r.file, r.stmt_idx, c.table_level, c.column, c.target, c.add_sql, c.start, c.end))
            yield pd.DataFrame(rows, columns=[f.split(" ")[0] for f in schema.split(", ")])

    tables = parsed.where("error is null and kind = 'create_table'").select("project", "dialect", "file", "stmt_idx", "text")
    return tables.mapInPandas(run, schema)
