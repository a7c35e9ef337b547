"""Editor requests as joins: what is at a place, where it is defined, what could follow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.editor import completion_context, identifier_span
from .catalog import definitions, references, statements


def spans(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """``project, file, start, stop, name, is_definition``: identifiers of definitions and references."""
    at = definitions(parsed).select("project", "file", "name", F.col("name_offset").alias("start"), F.lit(True).alias("is_definition"))
    at = at.unionByName(references(parsed).select("project", "file", "name", F.col("offset").alias("start"), F.lit(False).alias("is_definition")))

    @F.pandas_udf("int")
    def stop(content: pd.Series, start: pd.Series) -> pd.Series:
        return pd.Series([identifier_span(bytes(c).decode("latin-1"), s)[1] for c, s in zip(content, start)])

    joined = at.join(files.select("project", "file", "content"), ["project", "file"])
    return joined.select("project", "file", "start", stop("content", "start").alias("stop"), "name", "is_definition")


def name_at(requests: DataFrame, parsed: DataFrame, files: DataFrame) -> DataFrame:
    """``request, project, name`` for ``requests(request, project, file, offset)``: definitions come before references.

    A range join within a file: both sides meet on ``project, file``.
    """
    inside = (F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("stop"))
    held = requests.join(spans(parsed, files), ["project", "file"]).where(inside)
    best = F.min_by("name", F.struct(~F.col("is_definition"), F.col("start")))
    return held.groupBy("request", "project").agg(best.alias("name"))


def definition_of(requests: DataFrame, parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Where the name at each request is first defined."""
    first = definitions(parsed).where("rank = 1").select("project", "name", "kind", "file", "line", "col", "stmt_idx")
    return name_at(requests, parsed, files).join(first, ["project", "name"])


def hover(requests: DataFrame, parsed: DataFrame, files: DataFrame) -> DataFrame:
    """The defining statement with its comments, and its file."""
    found = definition_of(requests, parsed, files)
    texts = statements(parsed).select("project", "file", "stmt_idx", "comments", "text")
    shown = F.concat_ws("\n", "comments", "text")
    return found.join(texts, ["project", "file", "stmt_idx"]).select("request", "project", "name", "file", shown.alias("shown"))


def completions(requests: DataFrame, parsed: DataFrame, files: DataFrame) -> DataFrame:
    """``request, label, kind, file``: defined names that fit; only tables after REFERENCES and ON."""

    @F.pandas_udf("context string, prefix string")
    def context(content: pd.Series, offset: pd.Series) -> pd.DataFrame:
        rows = [completion_context(bytes(c).decode("latin-1"), o) for c, o in zip(content, offset)]
        return pd.DataFrame(rows, columns=["context", "prefix"])

    asked = requests.join(files.select("project", "file", "content"), ["project", "file"])
    asked = asked.select("request", "project", context("content", "offset").alias("c")).select("request", "project", "c.*").where("context != 'none'")
    names = definitions(parsed).where("rank = 1").select("project", F.col("name").alias("label"), "kind", "file")
    fits = F.lower("label").startswith(F.lower("prefix"))
    tables = (F.col("context") == "directive") | (F.col("kind") == "create_table")
    return asked.join(names, "project").where(fits & tables).select("request", "label", "kind", "file").orderBy("request", "label")


def open_files(opened: DataFrame, found: DataFrame) -> DataFrame:
    """Every open file with its diagnostics; an empty list where it has none."""
    one = F.struct("line", "col", "severity", "message")
    held = found.groupBy("project", "file").agg(F.sort_array(F.collect_list(one)).alias("diagnostics"))
    empty = F.array().cast("array<struct<line:int,col:int,severity:string,message:string>>")
    joined = opened.select("project", "file").distinct().join(held, ["project", "file"], "left")
    return joined.withColumn("diagnostics", F.coalesce("diagnostics", empty))
