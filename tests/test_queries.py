import os

import duckdb
import pytest

from lineagrid import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(str, r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, duck, name):
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(duck.sql(queries.oracle_sql()[name]).df())


def test_entry_works_without_the_optional_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "spark-warehouse")
    shutil.copytree(root, tmp_path / "r", ignore=skip)
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
held = e.queries()
assert "pipeline" not in held and not any(k.startswith("op") and k[2:3].isdigit() for k in held) and set(e.oracle_sql()) <= set(held)
assert held["s_statements"](spark, "").count() == 25
"""
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(tmp_path / "r"), os.environ.get("PYTHONPATH", "").replace(root, "")])}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=env)
