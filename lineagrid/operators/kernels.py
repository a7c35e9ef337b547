"""The relational kernels of schema analysis, on tables of any size.

The same operations that resolve names in a schema tree (resolve, anti-resolve,
first wins, overlays, components, levels, look-ups by range) as functions of
DataFrames, with keys as parameters.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with several rows, their number and how many are surplus."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.where("n > 1").withColumn("surplus", F.col("n") - 1)


def unresolved(refs: DataFrame, defs: DataFrame, ref: str, name: str) -> DataFrame:
    """References that nothing defines."""
    return refs.join(defs.select(F.col(name).alias(ref)).distinct(), ref, "left_anti")


def flagged_external(refs: DataFrame, defs: DataFrame, ref: str, name: str) -> DataFrame:
    """References with ``external``: true where nothing defines them."""
    known = defs.select(F.col(name).alias(ref)).distinct().withColumn("_known", F.lit(True))
    return refs.join(known, ref, "left").withColumn("external", F.col("_known").isNull()).drop("_known")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key: an aggregate with map-side combining, not a sort of each group."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_f")).select(*keys, *[F.col(f"_f.{c}").alias(c) for c in rest])


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, as an overlay of events."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("_l")).select(*keys, *[F.col(f"_l.{c}").alias(c) for c in rest])


def distinct_edges(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.select(F.col(start).alias("from"), F.col(end).alias("to")).where("from != to").distinct()


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("to").agg(F.count("*").alias("in_degree"))


def kept(df: DataFrame) -> DataFrame:
    """Cut lineage in loops: a reliable checkpoint where the session has a folder for it, else the cache."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.cache()
    path = f"{folder.rstrip('/')}/lineagrid-loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _settled(df: DataFrame, step, measure: Column) -> DataFrame:
    """``step`` applied until ``measure``, an aggregate, stays; each round is kept and the one before it released."""
    found = kept(df)
    mark = found.agg(measure).first()[0]
    while True:
        following = kept(step(found))
        now = following.agg(measure).first()[0]
        found.unpersist()
        found = following
        if now == mark:
            return found
        mark = now


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges left when those of nodes without a way in or out are taken away again and again."""

    def step(core: DataFrame) -> DataFrame:
        ends = core.select(F.col("from").alias("n")).intersect(core.select(F.col("to").alias("n")))
        return core.join(ends, core["from"] == ends["n"], "left_semi").join(ends, core["to"] == ends["n"], "left_semi")

    return _settled(edges, step, F.count("*"))


def cycle_members(edges: DataFrame) -> DataFrame:
    """``node, component``: nodes that reach themselves through others; the component is its least node.

    Each round colours every node with the least node that reaches it. The
    nodes that reach the node of their own colour are its component; they
    leave, and what remains is trimmed and coloured anew. Links are joined by
    their ends only, so the work is that of the links and never of all pairs.
    Loops and repeated links are ignored; null ends have no cycle.
    """
    core = _trimmed(edges.where("from != to").select("from", "to").distinct())
    found = None
    while not core.isEmpty():

        def colour(own: DataFrame) -> DataFrame:
            through = core.join(own, core["from"] == own["node"]).groupBy("to").agg(F.min("colour").alias("best"))
            joined = own.join(through, own["node"] == through["to"], "left")
            return joined.select("node", F.least("colour", "best").alias("colour"))

        nodes = core.select(F.col("from").alias("node")).distinct().withColumn("colour", F.col("node"))
        coloured = _settled(nodes, colour, F.sum(F.xxhash64("node", "colour").cast("decimal(38,0)")))
        ends = [coloured.select(F.col("node").alias(e), F.col("colour").alias(f"c_{e}")) for e in ("from", "to")]
        same = kept(core.join(ends[0], "from").join(ends[1], "to").where("c_from = c_to").select("from", "to", F.col("c_to").alias("colour")))

        def back(own: DataFrame) -> DataFrame:
            step = same.join(own.select(F.col("node").alias("to"), "colour"), ["to", "colour"]).select(F.col("from").alias("node"), "colour")
            return own.unionByName(step).distinct()

        members = _settled(coloured.where("node = colour"), back, F.count("*"))
        found = members if found is None else found.unionByName(members)
        gone = members.select("node")
        left = core.join(gone, core["from"] == gone["node"], "left_anti").join(gone, core["to"] == gone["node"], "left_anti")
        core = _trimmed(left)
    if found is None:
        return edges.select(F.col("from").alias("node"), F.col("to").alias("component")).where("false")
    several = found.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(several, "colour", "left_semi").select("node", F.col("colour").alias("component"))


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, level`` of an acyclic graph: the longest way to a node without dependencies, by relaxation.

    In a graph without cycles no way is longer than its nodes are many, so a
    further round that still changes a level raises ``ValueError``. Links to
    nodes that ``nodes`` does not list, and null ends, are ignored. What makes
    the links runs once, not in every round.
    """
    edges = kept(edges)
    found = kept(nodes.select(F.col("node"), F.lit(0).alias("level")).distinct())
    size, mark = found.agg(F.count("*"), F.sum("level")).first()
    for _ in range(size + 1):
        step = edges.join(found, edges["to"] == found["node"]).groupBy("from").agg((F.max("level") + 1).alias("up"))
        joined = found.join(step, found["node"] == step["from"], "left")
        nxt = kept(joined.select("node", F.greatest("level", F.coalesce("up", "level")).alias("level")))
        now = nxt.agg(F.sum("level")).first()[0]  # no level ever falls, so an equal sum has equal levels
        found.unpersist()
        if now == mark:
            return nxt
        found, mark = nxt, now
    raise ValueError("the graph has a cycle")


def line_starts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, start, length`` of each line, in bytes; offsets are running sums within the document."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    size = F.octet_length("line")
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size + 1).over(before), F.lit(0))
    return lines.select(key, (F.col("pos") + 1).alias("line_no"), start.cast("bigint").alias("start"), size.cast("bigint").alias("length"))


def spans_at(spans: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Spans that hold each point: ``start <= offset < start + length``, within a key."""
    inside = (F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("start") + F.col("length"))
    return points.join(spans, key).where(inside)


def folded(column: str) -> Column:
    """Identifier folding: names in double quotes keep their case, others do not."""
    inner = F.replace(F.expr(f"substring({column}, 2, length({column}) - 2)"), F.lit('""'), F.lit('"'))
    is_quoted = F.col(column).startswith('"') & F.col(column).endswith('"') & (F.length(column) >= 2)
    return F.when(is_quoted, inner).otherwise(F.lower(column))


def utf16_length(column: str) -> Column:
    """UTF-16 units: code points, and one more for each beyond the first plane."""
    return F.length(column) + F.length(F.regexp_replace(column, "[\\x{0}-\\x{FFFF}]", ""))


def word_count(column: str) -> Column:
    return F.size(F.regexp_extract_all(F.col(column), F.lit("([A-Za-z0-9_]+)")))
