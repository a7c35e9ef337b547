"""Schema trees as DataFrames: discovery, line ends, overlays, project configuration."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexing import check_dialect
from ..session import FILES

try:
    import yaml
except ImportError:  # optional: the plain form of the configuration needs no library
    yaml = None


def discover(root: str | Path) -> list[str]:
    """Relative slash paths of all ``.sql`` files, any case, in byte order; dot directories are left out.

    Spark's file listing hides names that begin with a dot or an underscore,
    so the tree is walked here.
    """
    found = []
    for folder, inner, names in os.walk(root):
        inner[:] = [d for d in inner if not d.startswith(".")]
        found += [os.path.relpath(os.path.join(folder, n), root) for n in names if n.lower().endswith(".sql")]
    if not found:
        raise FileNotFoundError(f"no .sql files found under {root}")
    return sorted((f.replace(os.sep, "/") for f in found), key=os.fsencode)


def read_tree(spark: SparkSession, root: str | Path, dialect: str, project: str = "") -> DataFrame:
    """``project, dialect, file, content`` of a tree on storage that all executors see; a file that cannot be read raises.

    The driver lists names, executors read contents.
    """
    names = discover(root)
    for f in names:
        if not os.access(os.path.join(root, f), os.R_OK):
            raise PermissionError(f"cannot read {os.path.join(root, f)}")
    rows = [(project, check_dialect(dialect), f) for f in names]
    listed = spark.createDataFrame(rows, "project string, dialect string, file string")
    base = os.path.abspath(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a file at a time: contents have any size
                row = batch.slice(k, 1)
                content = Path(base, row.column(2)[0].as_py()).read_bytes()
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], type=pa.binary())], names=["project", "dialect", "file", "content"])

    return unix_lines(listed.mapInArrow(read, FILES))


def from_texts(spark: SparkSession, texts: dict[str, str], dialect: str = "postgres", project: str = "") -> DataFrame:
    """The same from texts by file name."""
    rows = [(project, check_dialect(dialect), f, bytearray(t.encode())) for f, t in texts.items()]
    return unix_lines(spark.createDataFrame(rows, FILES))


def unix_lines(files: DataFrame) -> DataFrame:
    """Carriage return and newline become a newline; lone carriage returns stay."""
    text = F.decode("content", "ISO-8859-1")
    return files.withColumn("content", F.encode(F.replace(text, F.lit("\r\n"), F.lit("\n")), "ISO-8859-1"))


def strip_mark(files: DataFrame) -> DataFrame:
    """Strict mode: a UTF-8 byte order mark at the start of a file is no part of it."""
    marked = F.hex(F.substring("content", 1, 3)) == "EFBBBF"
    return files.withColumn("content", F.when(marked, F.expr("substring(content, 4)")).otherwise(F.col("content")))


def overlaid(files: DataFrame, overlay: DataFrame) -> DataFrame:
    """Open buffers (``project, file, content``) shadow the files; buffers without a file are not added."""
    held = overlay.select("project", "file", F.col("content").alias("_open"))
    joined = files.join(held, ["project", "file"], "left")
    return joined.withColumn("content", F.coalesce("_open", "content")).select(files.columns)


CONFIG_NAMES = ("lineagrid.yaml", "lineagrid.yml")
_KEYS = ("dialect", "schema_dir", "out")


class ConfigError(ValueError):
    """A project configuration that cannot be used."""


@dataclass(frozen=True)
class Config:
    path: Path
    dialect: str = ""
    schema_dir: str = ""
    out: str = ""


def find_config(start: str | Path, names: tuple[str, ...] = CONFIG_NAMES) -> Path:
    """The configuration of the nearest folder upwards that has one; two in one folder are an error."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        found = [folder / n for n in names if (folder / n).is_file()]
        if len(found) > 1:
            raise ConfigError(f"both {names[0]} and {names[1]} found in {folder}: keep only one")
        if found:
            return found[0]
    raise FileNotFoundError(f"{names[0]} not found (searched from {start} upward)")


def load_config(path: str | Path) -> Config:
    """A YAML mapping of settings; unknown and repeated keys and unknown dialects are errors, paths are relative to its folder.

    Read with a YAML library where there is one; else the subset that such
    files use: a setting a line, comments, plain and quoted scalars. An empty
    file is a configuration without settings.
    """
    path = Path(path)
    text = path.read_text(encoding="utf-8")
    held = _plain_settings(path, text) if yaml is None else _yaml_settings(path, text)
    if held.get("dialect"):
        try:
            check_dialect(held["dialect"])
        except ValueError as e:
            raise ConfigError(f"parsing {path}: {e}") from e
    place = lambda p: str(path.parent / p) if p else ""
    return Config(path, held.get("dialect", ""), place(held.get("schema_dir", "")), place(held.get("out", "")))


def _yaml_settings(path: Path, text: str) -> dict[str, str]:
    try:
        tree = yaml.compose(text, Loader=yaml.SafeLoader)
        found = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"parsing {path}: {e}") from e
    if found is None:
        return {}
    keys = [k.value for k, _ in tree.value] if isinstance(found, dict) else []
    if not keys or set(keys) - set(_KEYS) or len(set(keys)) < len(keys):
        raise ConfigError(f"parsing {path}: expected each of {', '.join(_KEYS)} once at most, found {keys or type(found).__name__}")
    if not all(v is None or isinstance(v, str) for v in found.values()):
        raise ConfigError(f"parsing {path}: settings are texts")
    return {k: v or "" for k, v in found.items()}


def _plain_settings(path: Path, text: str) -> dict[str, str]:
    held: dict[str, str] = {}
    for number, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#") or line.strip() in ("---", "..."):
            continue
        found = re.fullmatch(r"""([A-Za-z_]\w*)\s*:(?:\s+(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^#'"\s].*?)))?\s*(?:\s#.*)?""", line)
        if not found or found[1] not in _KEYS or found[1] in held:
            raise ConfigError(f"parsing {path}: line {number}: {line.strip()!r}")
        double, single, plain = found[2], found[3], found[4]
        held[found[1]] = re.sub(r"\\(.)", r"\1", double) if double is not None else (single.replace("''", "'") if single is not None else plain or "")
    return held
