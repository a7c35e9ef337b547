"""What is wrong with a schema tree: errors and warnings, in a stable order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import definitions, references

_COLUMNS = ["project", "file", "line", "col", "severity", "message", "emit_class", "emit_file", "emit_stmt", "emit_ord"]


def quoted(name: str | Column) -> Column:
    """A name in double quotes, with backslashes and quotes escaped."""
    column = F.col(name) if isinstance(name, str) else name
    return F.concat(F.lit('"'), F.regexp_replace(column, r'(["\\])', r"\\$1"), F.lit('"'))


def _place(prefix: str = "") -> Column:
    return F.concat_ws(":", f"{prefix}file", F.col(f"{prefix}line").cast("string"), F.col(f"{prefix}col").cast("string"))


def lex_errors(parsed: DataFrame) -> DataFrame:
    rows = parsed.where("error is not null")
    return rows.select(
        "project", "file", F.lit(1).alias("line"), F.lit(1).alias("col"), F.lit("error").alias("severity"),
        F.concat_ws(": ", "file", "error").alias("message"),
        F.lit(0).alias("emit_class"), F.col("file").alias("emit_file"), F.lit(-1).alias("emit_stmt"), F.lit(0).alias("emit_ord"),
    )


def duplicate_definitions(parsed: DataFrame, strict: bool = False) -> DataFrame:
    """An error at every definition of a name but the first."""
    found = definitions(parsed, strict)
    first = found.where("rank = 1").select(
        "project", "name", F.col("file").alias("first_file"), F.col("line").alias("first_line"), F.col("col").alias("first_col")
    )
    later = found.where("rank > 1").join(first, ["project", "name"])
    message = F.concat(
        F.lit("duplicate definition of "), quoted("name"), F.lit(": first defined at "), _place("first_"), F.lit(", redefined at "), _place()
    )
    return later.select(
        "project", "file", "line", "col", F.lit("error").alias("severity"), message.alias("message"),
        F.lit(0).alias("emit_class"), F.col("file").alias("emit_file"), F.col("stmt_idx").alias("emit_stmt"), F.lit(0).alias("emit_ord"),
    )


def unresolved_references(parsed: DataFrame) -> DataFrame:
    """A warning at every detected or required reference that nothing defines; view sources are not checked."""
    known = definitions(parsed).select("project", "name").distinct()
    missing = references(parsed).where("ref_kind != 'view_scan'").join(known, ["project", "name"], "left_anti")
    message = F.concat(F.lit("unknown reference "), quoted("name"), F.lit(": not defined in this schema"))
    return missing.select(
        "project", "file", "line", "col", F.lit("warning").alias("severity"), message.alias("message"),
        F.lit(1).alias("emit_class"), F.col("file").alias("emit_file"), F.col("stmt_idx").alias("emit_stmt"), F.col("ref_ord").alias("emit_ord"),
    )


def diagnostics(parsed: DataFrame, cycles: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """All diagnostics by file, line and column; ties in the order in which they arise.

    ``cycles`` holds ``project, file, line, col, message`` of cycles that cannot be split.
    """
    found = lex_errors(parsed).unionByName(duplicate_definitions(parsed, strict)).unionByName(unresolved_references(parsed))
    if cycles is not None:
        found = found.unionByName(
            cycles.select(
                "project", "file", "line", "col", F.lit("error").alias("severity"), "message",
                F.lit(2).alias("emit_class"), F.col("file").alias("emit_file"), F.lit(0).alias("emit_stmt"), F.lit(0).alias("emit_ord"),
            )
        )
    order = ["project", "file", "line", "col", "emit_class", "emit_file", "emit_stmt", "emit_ord"]
    return found.select(_COLUMNS).orderBy(*order).drop("emit_class", "emit_file", "emit_stmt", "emit_ord")


def lines(found: DataFrame) -> DataFrame:
    return found.select("project", F.concat_ws(": ", _place(), "severity", "message").alias("line"))


def has_error(found: DataFrame) -> DataFrame:
    return found.groupBy("project").agg(F.bool_or(F.col("severity") == "error").alias("has_error"))
