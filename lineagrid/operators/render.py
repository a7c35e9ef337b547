"""Texts of bundles and graphs.

Lines are DataFrame columns; only the last step, putting a project's lines
together, aggregates.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .diagnostics import quoted

TOOL = "lineagrid"

#: DOT shapes by node kind and line styles by edge kind; fixed values.
SHAPES = {
    "table": "box", "view": "ellipse", "index": "note", "function": "component", "trigger": "diamond", "type": "hexagon",
    "sequence": "cylinder", "extension": "folder", "unknown": "plaintext",
}
STYLES = {"view": "dashed", "directive": "dashed", "on": "dotted"}


def _lookup(values: dict[str, str], key: str, default: str) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(F.col(key) == k, v).otherwise(out)
    return out


def bundle_chunks(ordered: DataFrame, tool: str = TOOL, strict: bool = False) -> DataFrame:
    """``project, place, chunk``: the text each statement adds to the bundle; a source line wherever the file changes."""
    before = F.lag("file").over(Window.partitionBy("project").orderBy("place"))
    head = F.when(before.isNull() | (before != F.col("file")), F.concat(F.lit("\n-- source: "), "file", F.lit("\n"))).otherwise(F.lit("\n"))
    moved = F.concat(F.lit(f"-- fk constraint moved by {tool} to break a dependency cycle (from "), "file", F.lit(")\n"))
    comments = F.array_join(F.transform("comments", lambda c: F.concat(c, F.lit("\n"))), "")
    ended = F.concat("text", F.lit(";\n"))
    if strict:  # a comment in the last line would swallow the semicolon
        last = F.element_at(F.split("text", "\n"), -1)
        ended = F.when(last.rlike("--|#"), F.concat("text", F.lit("\n;\n"))).otherwise(ended)
    chunk = F.concat(head, F.when(F.col("synthesized"), moved).otherwise(F.lit("")), comments, ended)
    return ordered.where("error is null").select("project", "place", chunk.alias("chunk"))


def bundle_text(ordered: DataFrame, tool: str = TOOL, strict: bool = False) -> DataFrame:
    """``project, sql``: the whole bundle of each project."""
    chunks = bundle_chunks(ordered, tool, strict).groupBy("project").agg(F.sort_array(F.collect_list(F.struct("place", "chunk"))).alias("c"))
    head = F.lit(f"-- Code generated by {tool}; DO NOT EDIT.\n")
    return chunks.select("project", F.concat(head, F.array_join(F.transform("c", lambda c: c["chunk"]), "")).alias("sql"))


def safe_id(column: str | Column) -> Column:
    """An identifier for diagrams: other characters become underscores, a short hash keeps ids apart."""
    name = F.col(column) if isinstance(column, str) else column
    return F.concat(F.lit("n_"), F.regexp_replace(name, "[^A-Za-z0-9]", "_"), F.lit("_"), F.substring(F.sha1(name.cast("binary")), 1, 8))


def _text(lines: DataFrame, head: str, tail: str) -> DataFrame:
    held = lines.groupBy("project").agg(F.sort_array(F.collect_list(F.struct("part", "a", "b", "c", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: F.concat(x["line"], F.lit("\n"))), "")
    return held.select("project", F.concat(F.lit(head), body, F.lit(tail)).alias("text"))


def _keyed(df: DataFrame, part: int, keys: list[str], line: Column) -> DataFrame:
    keys = [F.col(k) for k in keys] + [F.lit("")] * (3 - len(keys))
    return df.select("project", F.lit(part).alias("part"), *[k.alias(n) for k, n in zip(keys, "abc")], line.alias("line"))


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``project, text``: Graphviz digraphs."""
    red = F.when(F.col("in_cycle"), F.lit(', color="red"')).otherwise(F.lit(""))
    dashed = F.when(F.col("external"), F.lit(', style="dashed"')).otherwise(F.lit(""))
    shape = _lookup(SHAPES, "kind", "box")
    node = F.concat(F.lit("  "), quoted("id"), F.lit(" [label="), quoted("id"), F.lit(", shape="), shape, dashed, red, F.lit("];"))
    style = _lookup(STYLES, "kind", "solid")
    edge = F.concat(
        F.lit("  "), quoted("from"), F.lit(" -> "), quoted("to"), F.lit(" [label="), quoted("kind"), F.lit(", style="), style, red, F.lit("];")
    )
    lines = _keyed(nodes, 0, ["id"], node).unionByName(_keyed(edges, 1, ["from", "to", "kind"], edge))
    return _text(lines, "digraph dependencies {\n  rankdir=LR;\n", "}\n")


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``project, text``: Mermaid flowcharts; links of cycles are styled by their number."""
    label = F.replace(F.col("id"), F.lit('"'), F.lit("#quot;"))
    box = F.when(F.col("external"), F.concat(F.lit("((("), label, F.lit(")))"))).otherwise(F.concat(F.lit("["), label, F.lit("]")))
    marked = F.when(F.col("in_cycle"), F.concat(F.lit("\n  class "), safe_id("id"), F.lit(" cycle"))).otherwise(F.lit(""))
    node = F.concat(F.lit("  "), safe_id("id"), box, marked)
    arrow = F.when(F.col("kind").isin("view", "directive", "on"), F.lit("-.->")).otherwise(F.lit("-->"))
    edge = F.concat(F.lit("  "), safe_id("from"), F.lit(" "), arrow, F.lit("|"), "kind", F.lit("| "), safe_id("to"))
    number = F.row_number().over(Window.partitionBy("project").orderBy("from", "to", "kind")) - 1
    numbered = edges.withColumn("n", F.lpad(number.cast("string"), 12, "0")).where("in_cycle")
    style = F.concat(F.lit("  linkStyle "), F.col("n").cast("int").cast("string"), F.lit(" stroke:#ff0000,stroke-width:2px"))
    projects = nodes.select("project").distinct()
    lines = _keyed(nodes, 0, ["id"], node).unionByName(_keyed(edges, 1, ["from", "to", "kind"], edge))
    lines = lines.unionByName(_keyed(projects, 2, [], F.lit("  classDef cycle stroke:#ff0000,stroke-width:2px")))
    return _text(lines.unionByName(_keyed(numbered, 3, ["n"], style)), "graph TD\n", "")


def graph_json(nodes: list[dict], edges: list[dict]) -> str:
    """A graph as indented JSON; empty fields of nodes are left out, a graph without edges has null."""
    shown = []
    for n in sorted(nodes, key=lambda n: n["id"].encode()):
        row = {"id": n["id"], "kind": n["kind"]}
        row |= {k: v for k, v in (("file", n["file"]), ("line", n["line"]), ("col", n["col"])) if v}
        row |= {k: True for k, v in (("external", n["external"]), ("inCycle", n["in_cycle"])) if v}
        shown.append(row)
    links = [
        {"from": e["from"], "to": e["to"], "kind": e["kind"], "inCycle": e["in_cycle"]}
        for e in sorted(edges, key=lambda e: (e["from"].encode(), e["to"].encode(), e["kind"]))
    ]
    text = json.dumps({"version": 1, "nodes": shown, "edges": links or None}, indent=2, ensure_ascii=False)
    for c in "<>&":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text + "\n"
