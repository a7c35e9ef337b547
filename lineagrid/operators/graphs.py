"""Dependency edges, their kinds, cycles and orders.

Edges and kinds are DataFrame operations over any number of projects. Orders
that are sequential by definition run once for each project, as plain
functions on its small node list.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import definitions, references


@dataclass(frozen=True)
class Node:
    """A statement in a dependency order; keys are compared as bytes."""

    file: str
    index: int
    sub: int
    name: str
    deps: tuple[str, ...] = ()

    @property
    def key(self) -> tuple[bytes, int, int]:
        return (self.file.encode(), self.index, self.sub)


def resolve(nodes: Sequence[Node]) -> list[list[int]]:
    """For each node, the distinct nodes it depends on; of equal names the last node counts."""
    named = {n.name: k for k, n in enumerate(nodes) if n.name}
    return [sorted({named[d] for d in n.deps if d in named} - {k}) for k, n in enumerate(nodes)]


def smallest_order(nodes: Sequence[Node]) -> tuple[list[int], list[int]]:
    """The smallest topological order by key, and the nodes left because of cycles."""
    needs = resolve(nodes)
    waits = [len(n) for n in needs]
    users: list[list[int]] = [[] for _ in nodes]
    for k, own in enumerate(needs):
        for d in own:
            users[d].append(k)
    ready = [(nodes[k].key, k) for k, n in enumerate(waits) if n == 0]
    heapq.heapify(ready)
    out = []
    while ready:
        _, k = heapq.heappop(ready)
        out.append(k)
        for u in users[k]:
            waits[u] -= 1
            if waits[u] == 0:
                heapq.heappush(ready, (nodes[u].key, u))
    done = set(out)
    return out, [k for k in range(len(nodes)) if k not in done]


def cycle_path(nodes: Sequence[Node], left: Sequence[int]) -> list[int]:
    """One cycle among the nodes that are left, closed on its first node.

    Walks from the smallest node, always to the smallest next one, until a
    node repeats; what led into the loop is cut off.
    """
    inside, needs = set(left), resolve(nodes)
    path = [min(left, key=lambda k: nodes[k].key)]
    while True:
        following = [d for d in needs[path[-1]] if d in inside]
        if not following:
            return path
        step = min(following, key=lambda k: nodes[k].key)
        if step in path:
            return path[path.index(step) :] + [step]
        path.append(step)


def cycle_message(nodes: Sequence[Node], path: Sequence[int], note: str = "") -> str:
    shown = " -> ".join(f"{nodes[k].file}:{nodes[k].name}" for k in path)
    return f"dependency cycle detected: {shown}" + (f" ({note})" if note else "")


def strong_components(nodes: Sequence[Node]) -> list[list[int]]:
    """Components of more than one node, each and all in key order: two depth-first passes without recursion."""
    ahead = resolve(nodes)
    back: list[list[int]] = [[] for _ in nodes]
    for k, own in enumerate(ahead):
        for d in own:
            back[d].append(k)
    finished: list[int] = []
    seen = [False] * len(nodes)
    for root in range(len(nodes)):
        if seen[root]:
            continue
        seen[root] = True
        stack = [(root, iter(ahead[root]))]
        while stack:
            k, rest = stack[-1]
            step = next((d for d in rest if not seen[d]), None)
            if step is None:
                finished.append(k)
                stack.pop()
            else:
                seen[step] = True
                stack.append((step, iter(ahead[step])))
    owner: dict[int, int] = {}
    for root in reversed(finished):
        if root in owner:
            continue
        owner[root], stack2 = root, [root]
        while stack2:
            for d in back[stack2.pop()]:
                if d not in owner:
                    owner[d] = root
                    stack2.append(d)
    groups: dict[int, list[int]] = {}
    for k, root in owner.items():
        groups.setdefault(root, []).append(k)
    found = [sorted(g, key=lambda k: nodes[k].key) for g in groups.values() if len(g) > 1]
    return sorted(found, key=lambda g: nodes[g[0]].key)


def classified(parsed: DataFrame) -> DataFrame:
    """References with the kind of edge they make: fk, on, view, directive or alter.

    The first detected reference of an index or trigger is its ``on``.
    """
    refs = references(parsed)
    nth = F.row_number().over(Window.partitionBy("project", "file", "stmt_idx", "ref_kind").orderBy("ref_ord"))
    own = (F.col("stmt_kind") == "alter_table") & (F.col("name") == F.col("from_name"))
    kind = (
        F.when(F.col("ref_kind") == "view_scan", "view")
        .when(F.col("ref_kind") == "directive", "directive")
        .when(own & (nth == 1), "alter")
        .when(F.col("stmt_kind").isin("create_index", "create_trigger") & (nth == 1), "on")
        .otherwise("fk")
    )
    return refs.withColumn("edge_kind", kind)


def edges(parsed: DataFrame) -> DataFrame:
    """Distinct ``project, from, to, kind``: no self edges, and no view sources that nothing defines."""
    known = definitions(parsed).select("project", "name").distinct().withColumn("defined", F.lit(True))
    found = classified(parsed).where("from_name != '' and from_name != name").join(known, ["project", "name"], "left")
    found = found.where((F.col("edge_kind") != "view") | F.col("defined"))
    found = found.select("project", F.col("from_name").alias("from"), F.col("name").alias("to"), F.col("edge_kind").alias("kind"))
    return found.distinct()


def nodes(parsed: DataFrame) -> DataFrame:
    """Every defined name at its first definition, and undefined targets as external nodes."""
    label = F.regexp_replace(F.regexp_replace("kind", "^(create|alter)_", ""), "^$", "other")
    own = definitions(parsed).where("rank = 1")
    own = own.select("project", F.col("name").alias("id"), label.alias("kind"), "file", "line", "col", F.lit(False).alias("external"))
    targets = edges(parsed).select("project", F.col("to").alias("id")).distinct()
    outside = targets.join(own.select("project", "id"), ["project", "id"], "left_anti")
    outside = outside.select(
        "project", "id", F.lit("unknown").alias("kind"), F.lit("").alias("file"), F.lit(0).alias("line"), F.lit(0).alias("col"), F.lit(True).alias("external")
    )
    return own.unionByName(outside)


def node_rows(parsed: DataFrame) -> DataFrame:
    """Statements as nodes of the order, with their distinct dependencies."""
    deps = F.array_distinct(F.transform("refs", lambda r: r["name"]))
    rows = parsed.where("error is null")
    return rows.select("project", "file", "stmt_idx", "sub_idx", "name", deps.alias("deps"))


def _as_nodes(frame: pd.DataFrame) -> list[Node]:
    frame = frame.sort_values(["file", "stmt_idx", "sub_idx"], key=lambda c: c.str.encode("utf-8") if c.dtype == object else c)
    return [Node(r.file, int(r.stmt_idx), int(r.sub_idx), r.name, tuple(r.deps)) for r in frame.itertuples(index=False)]


def components_by_project(parsed: DataFrame) -> DataFrame:
    """``project, component, name``: members of dependency cycles, components numbered in key order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        held = _as_nodes(frame)
        rows = [(frame["project"].iloc[0], c, held[k].name) for c, own in enumerate(strong_components(held)) for k in own]
        return pd.DataFrame(rows, columns=["project", "component", "name"])

    return node_rows(parsed).groupBy("project").applyInPandas(run, "project string, component int, name string")


def order_by_project(parsed: DataFrame) -> DataFrame:
    """``project, place, file, stmt_idx, sub_idx, name``: the smallest dependency order; nodes of cycles have no row."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        held = _as_nodes(frame)
        order, _ = smallest_order(held)
        rows = [(frame["project"].iloc[0], p, held[k].file, held[k].index, held[k].sub, held[k].name) for p, k in enumerate(order)]
        return pd.DataFrame(rows, columns=["project", "place", "file", "stmt_idx", "sub_idx", "name"])

    schema = "project string, place int, file string, stmt_idx int, sub_idx int, name string"
    return node_rows(parsed).groupBy("project").applyInPandas(run, schema)


def exported(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with ``in_cycle``: an edge is in a cycle when both ends share a component."""
    member = components_by_project(parsed).where("name != ''").select("project", "name", "component").distinct()
    ends = [member.select("project", F.col("name").alias(e), F.col("component").alias(f"_{e}")) for e in ("from", "to")]
    found = edges(parsed).join(ends[0], ["project", "from"], "left").join(ends[1], ["project", "to"], "left")
    found = found.select("project", "from", "to", "kind", F.coalesce(F.col("_from") == F.col("_to"), F.lit(False)).alias("in_cycle"))
    flagged = nodes(parsed).join(member.select("project", F.col("name").alias("id"), F.lit(True).alias("_in")).distinct(), ["project", "id"], "left")
    flagged = flagged.withColumn("in_cycle", F.coalesce("_in", F.lit(False))).drop("_in")
    return flagged, found
