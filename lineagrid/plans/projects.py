"""Whole plans: bundle, check and graph of schema trees, for any number of projects at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.drawing import svg
from ..functions.statements import PREFIX
from ..operators import catalog, diagnostics, graphs, render, repair
from ..sources import files as sources


class SchemaError(ValueError):
    """The first error that keeps a project from being bundled."""


def parse(files: DataFrame, strict: bool = False, prefix: str = PREFIX) -> DataFrame:
    """Parsed statements; ``strict`` also drops byte order marks and splits requirement lists at commas.

    ``prefix`` is the tool whose comments name requirements; trees that were
    written for another tool keep theirs.
    """
    return catalog.parse_files(sources.strip_mark(files) if strict else files, strict, prefix)


def check(files: DataFrame, strict: bool = False, prefix: str = PREFIX) -> DataFrame:
    """All diagnostics, unsplittable cycles included."""
    parsed = parse(files, strict, prefix)
    cycles = repair.cycles(repair.repaired(parsed, strict), catalog.definitions(parsed, strict))
    return diagnostics.diagnostics(parsed, cycles, strict)


def bundle(files: DataFrame, tool: str = render.TOOL, strict: bool = False, prefix: str = PREFIX) -> DataFrame:
    """``project, sql, error``: the bundle, or the first error (lex errors and duplicates before cycles)."""
    parsed = parse(files, strict, prefix)
    fixed = repair.repaired(parsed, strict)
    early = diagnostics.diagnostics(parsed, None, strict).where("severity = 'error'")
    early = early.groupBy("project").agg(F.min_by("message", F.struct("file", "line", "col")).alias("early"))
    late = fixed.where("error is not null").select("project", F.col("error").alias("late"))
    texts = render.bundle_text(fixed, tool, strict)
    out = files.select("project").distinct().join(texts, "project", "left").join(early, "project", "left").join(late, "project", "left")
    error = F.coalesce("early", "late")
    return out.select("project", F.when(error.isNull(), F.col("sql")).alias("sql"), error.alias("error"))


def bundle_or_raise(files: DataFrame, tool: str = render.TOOL, strict: bool = False, prefix: str = PREFIX) -> str:
    """The bundle of a single project."""
    row = bundle(files, tool, strict, prefix).first()
    if row["error"]:
        raise SchemaError(row["error"])
    return row["sql"] or f"-- Code generated by {tool}; DO NOT EDIT.\n"


def graph(files: DataFrame, form: str = "dot", strict: bool = False, prefix: str = PREFIX) -> str:
    """The graph of a single project as ``dot``, ``mermaid``, ``json`` or ``svg``; cycles are marked, never an error.

    The text is one string on the driver: it is meant for a project that people look at.
    """
    nodes, edges = graphs.exported(parse(files, strict, prefix))
    if form in ("json", "svg"):
        return (render.graph_json if form == "json" else svg)([r.asDict() for r in nodes.collect()], [r.asDict() for r in edges.collect()])
    if form not in ("dot", "mermaid"):
        raise ValueError(f'unknown format "{form}" (expected dot, mermaid, json, or svg)')
    made = (render.dot if form == "dot" else render.mermaid)(nodes, edges).first()
    empty = {"dot": "digraph dependencies {\n  rankdir=LR;\n}\n", "mermaid": "graph TD\n  classDef cycle stroke:#ff0000,stroke-width:2px\n"}
    return made["text"] if made else empty[form]
