"""Statements, tokens, definitions and references of schema trees.

One Python pass splits and parses each file, in partitions of files; what
follows is projection and explosion of its nested columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lexing import LexError, split
from ..functions.positions import LineMap
from ..functions.statements import PREFIX, facts
from ..session import PARSED

def _utf8(view: str) -> str:
    return view.encode("latin-1").decode("utf-8", "replace")


def parse_content(content: bytes, dialect: str, strict: bool = False, prefix: str = PREFIX) -> list[dict]:
    """One row for each statement of a file, or one with ``error``."""
    source = bytes(content).decode("latin-1")
    try:
        found = split(source, dialect)
    except LexError as e:
        return [{"stmt_idx": -1, "sub_idx": 0, "kind": "", "name": "", "text": "", "line": 1, "col": 1, "error": str(e)}]
    lines, out = LineMap(source), []
    for k, statement in enumerate(found):
        own = facts(statement, strict=strict, prefix=prefix)
        line, col = lines.locate(own.name_offset)
        refs = [(_utf8(r.name) if r.kind != "directive" else r.name, r.kind, r.offset, *lines.locate(r.offset)) for r in own.refs]
        out.append({
            "stmt_idx": k, "sub_idx": 0, "kind": own.kind, "name": _utf8(own.name), "name_offset": own.name_offset,
            "line": line, "col": col, "start": statement.start, "end": statement.end, "text": _utf8(statement.text),
            "comments": [_utf8(c) for c, _ in statement.comments],
            "refs": [dict(zip(("name", "ref_kind", "offset", "line", "col"), r)) for r in refs],
            "tokens": [
                {"kind": t.kind, "raw": _utf8(t.raw) if t.kind != "punct" else t.raw, "value": _utf8(t.value) if t.kind != "punct" else t.value, "start": t.start, "end": t.end}
                for t in statement.tokens
            ],
            "error": None,
        })
    return out


def parse_files(files: DataFrame, strict: bool = False, prefix: str = PREFIX) -> DataFrame:
    """``files(project, dialect, file, content)`` as one row for each statement (``session.PARSED``).

    A file that cannot be split has one row with ``error`` and no statement.
    Requirement comments begin with ``prefix``, a tool's name.
    """
    columns = [f.name for f in files.sparkSession.createDataFrame([], PARSED).schema]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for project, dialect, file, content in frame.itertuples(index=False):
                for row in parse_content(content, dialect, strict, prefix):
                    rows.append({"project": project, "dialect": dialect, "file": file} | row)
            made = pd.DataFrame(rows, columns=columns)
            for name in ("stmt_idx", "sub_idx", "name_offset", "line", "col", "start", "end"):
                made[name] = made[name].fillna(0).astype("int32")
            for name in ("comments", "refs", "tokens"):
                made[name] = [x if isinstance(x, list) else [] for x in made[name]]
            yield made

    return files.select("project", "dialect", "file", "content").mapInPandas(run, PARSED)


def statements(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is null").drop("tokens", "error")


def tokens(parsed: DataFrame) -> DataFrame:
    exploded = parsed.where("error is null").select("project", "file", "stmt_idx", F.posexplode("tokens").alias("tok_idx", "t"))
    return exploded.select("project", "file", "stmt_idx", "tok_idx", "t.*")


def definitions(parsed: DataFrame, strict: bool = False) -> DataFrame:
    """All definitions with ``rank``, 1 for the first of a name; ``strict`` leaves out ALTER TABLE."""
    named = parsed.where("error is null and name != ''")
    if strict:
        named = named.where("kind != 'alter_table'")
    order = Window.partitionBy("project", "name").orderBy("file", "stmt_idx")
    columns = ["project", "name", "kind", "file", "stmt_idx", "name_offset", "line", "col"]
    return named.select(*columns).withColumn("rank", F.row_number().over(order))


def references(parsed: DataFrame) -> DataFrame:
    rows = parsed.where("error is null")
    rows = rows.select(
        "project", "file", "stmt_idx", F.col("kind").alias("stmt_kind"), F.col("name").alias("from_name"), F.posexplode("refs").alias("ref_ord", "r")
    )
    return rows.select("project", "file", "stmt_idx", "stmt_kind", "from_name", "ref_ord", "r.*")


def definition_names(parsed: DataFrame) -> DataFrame:
    return definitions(parsed).select("project", "name").distinct().orderBy("project", "name")


def register(spark: SparkSession) -> None:
    """Make ``sql_split(content, dialect)`` a table function of the session."""
    from pyspark.sql.functions import udtf

    class SqlSplit:
        def eval(self, content: str, dialect: str) -> Iterator[tuple]:
            for row in parse_content(content.encode(), dialect):
                yield row["stmt_idx"], row["kind"], row["name"], row["text"], row["error"]

    spark.udtf.register("sql_split", udtf(SqlSplit, returnType="stmt_idx int, kind string, name string, text string, error string"))
