"""Session helpers and the schemas of the package's tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

FILES = "project string, dialect string, file string, content binary"
TOKEN = "struct<kind:string,raw:string,value:string,start:int,end:int>"
REF = "struct<name:string,ref_kind:string,offset:int,line:int,col:int>"
PARSED = (
    "project string, dialect string, file string, stmt_idx int, sub_idx int, kind string, name string, name_offset int, "
    f"line int, col int, start int, end int, text string, comments array<string>, refs array<{REF}>, "
    f"tokens array<{TOKEN}>, error string"
)
NODES = "id string, kind string, file string, line int, col int, external boolean, in_cycle boolean"
EDGES = "from string, to string, kind string, in_cycle boolean"


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and tools on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lineagrid")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
