"""Shared helpers: table access, reliable materialisation, bounded Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch between the JVM and a Python worker. Texts
#: may be very long, so batches are kept small in rows as well as in bytes: a
#: worker holds ten times the bytes of a batch of texts, or more, while it works.
BATCH_ROWS = 20_000
BATCH_BYTES = 2 << 20


#: Tables whose files have fewer bytes are dealt over all cores as they are read.
SPREAD_BYTES = 64 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table. A small one often is a single row group, that is one task: it is dealt anew, a shuffle of bounded size."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(spark.sparkContext.defaultParallelism) if size < SPREAD_BYTES else table


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python stages of this session receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only when the setting is absent and the master is local (single-machine
    tests) a folder of this process is chosen; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _own_dir
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="lineagrid-")
    return f"file://{_own_dir}"


_own_dir: str | None = None
_written: list[str] = []
_tables: list[str] = []


#: Spark deletes the shuffle files of a query when it ends, not only when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str = "table", tidy: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage and fixes every nondeterministic id; the files survive lost
    executors. They are deleted when the driver's Python ends. With ``tidy``,
    the shuffle files of the write, which nothing reads again, go as it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lineagrid-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true" if tidy else before)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if not _written:
        atexit.register(_remove_written)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As ``materialise``, but in buckets of ``key``: a join on it with as many partitions needs no shuffle here."""
    spark = df.sparkSession
    table = f"lineagrid_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    writer = df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key)
    writer.format("parquet").saveAsTable(table)
    if not _written:
        atexit.register(_remove_written)
    _written.append(path)
    _tables.append(table)
    return spark.table(table)


def discard(df: DataFrame) -> None:
    """Delete a materialised table that no later step reads."""
    for path in [p for p in _written if any(p.rsplit("/", 1)[1] in f for f in df.inputFiles()[:1])]:
        _remove(df.sparkSession, path)
        _written.remove(path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_written() -> None:
    spark = SparkSession.getActiveSession()
    for path in _written if spark is not None else []:
        try:
            while _tables:
                spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
            _remove(spark, path)
        except Exception:  # the context may have stopped already; nothing depends on it
            return


def text_bytes(column: str = "text") -> F.Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def release_memory() -> None:
    """Give back what this process has freed: idle workers otherwise keep it beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, after which the worker's freed memory is given back."""

    def run_and_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return run_and_release


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str
) -> DataFrame:
    """``mapInArrow`` with a per-task state: ``make()`` runs once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            out = step(batch)
            del batch  # not held while the next one is read
            if out is not None and out.num_rows:
                yield out
            del out

    bound_batches(df.sparkSession)
    return df.mapInArrow(releasing(run), schema)


#: Bytes of texts that an encoder takes at once: larger batches repeat fewer words but hold more of a worker's memory.
GATHERED_BYTES = 8 << 20


def gathered(batches: Iterator[pa.RecordBatch], size: int = GATHERED_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in their order, in batches of ``size`` bytes at most; a larger batch stays as it is."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > size:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
        del batch
    if held:
        yield pa.concat_batches(held)


#: Bits of a membership table, whatever the number of members.
TABLE_BITS = 1 << 25


def bit_table(members: DataFrame, column: str) -> np.ndarray:
    """A table of ``TABLE_BITS`` bits in which those of all 64-bit hashes in ``column`` are set.

    At most ``TABLE_BITS / 32`` rows reach the driver. ``in_table`` is true for
    all members and, while they are far fewer than bits, for few others; it
    spares a shuffle and is followed by an exact join.
    """
    place = F.pmod(column, F.lit(TABLE_BITS))
    words = members.select(
        F.floor(place / 32).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod({column}, 32) as int))").alias("b")
    )
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(TABLE_BITS // 32, dtype=np.uint32)
    table[found["w"].to_numpy()] = found["b"].to_numpy().astype(np.uint32)
    return table


def in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes.astype(np.int64) % TABLE_BITS
    return (table[place // 32] >> (place % 32).astype(np.uint32)) & 1 > 0


#: Keys of a set that are broadcast at most: the ones with most rows.
HOT = 1 << 17


@dataclass
class Members:
    """A set of 64-bit keys: the ``HOT`` heaviest at hand, the rest (if any) as a table ``key, docs``.

    The rest holds no heavy key, so a join with it has no hot group.
    """

    hot: np.ndarray
    rest: DataFrame | None

    def broadcast(self, spark: SparkSession):
        """Broadcasts for workers: the sorted hot keys, and a bit table of the rest or None."""
        send = spark.sparkContext.broadcast
        return send(self.hot), send(bit_table(self.rest, "key")) if self.rest is not None else None


def among(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which ``keys`` are in the sorted array ``held``."""
    if not len(held):
        return np.zeros(len(keys), dtype=bool)
    return held[np.minimum(np.searchsorted(held, keys), len(held) - 1)] == keys


def members(keys: DataFrame, hot: int = HOT) -> Members:
    """The set of distinct ``key`` in ``keys(key, docs)``, a written table; ``docs`` is a key's weight."""
    top = keys.orderBy(F.desc("docs"), "key").limit(hot).toArrow()  # at most ``hot`` rows
    held = np.sort(top["key"].to_numpy())
    if len(held) < hot:
        return Members(held, None)
    last = pc.min(top["docs"]).as_py()
    after = int(top["key"].to_numpy()[top["docs"].to_numpy() == last].max())
    rest = keys.where((F.col("docs") < last) | ((F.col("docs") == last) & (F.col("key") > after)))
    return Members(held, rest)


def within(df: DataFrame, column: str, found: Members) -> DataFrame:
    """Rows of ``df`` whose ``column`` is a member; a hot key needs no shuffle."""
    spark = df.sparkSession
    hot = spark.createDataFrame(pa.table({column: pa.array(found.hot, type=pa.int64())}))
    sure = df.join(F.broadcast(hot), column, "left_semi")
    if found.rest is None:
        return sure
    others = df.join(F.broadcast(hot), column, "left_anti")
    return sure.unionByName(others.join(found.rest.select(F.col("key").alias(column)), column, "left_semi"))


#: Groups that are broadcast at most when rows are joined with them: the ones with most rows.
HOT_GROUPS = 10_000


def join_hot(df: DataFrame, groups: DataFrame, keys: list[str], weight: str, limit: int = HOT_GROUPS) -> DataFrame:
    """Inner join of ``df`` with ``groups`` (one row for each value of ``keys``), both written tables.

    The ``limit`` groups with the largest ``weight`` (their rows in ``df``) are
    broadcast; any other has less than one in ``limit`` of the rows, so no task
    of the join of the rest gets a large share.
    """
    top = groups.orderBy(F.desc(weight), *keys).limit(limit).toArrow()  # at most ``limit`` rows
    hot = df.sparkSession.createDataFrame(top, groups.schema)
    sure = df.join(F.broadcast(hot), keys)
    if top.num_rows < limit:
        return sure
    rest = df.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return sure.unionByName(rest.join(groups, keys))


#: Rows with one key that a salted join puts together.
SALTED_ROWS = 1000


def join_salted(df: DataFrame, table: DataFrame, key: str, rows: int = SALTED_ROWS, limit: int = HOT_GROUPS) -> DataFrame:
    """Inner join of ``df`` (a written table) with ``table``, which has one wide row for each ``key``.

    Keys with more than ``rows`` rows in ``df``, the ``limit`` heaviest of
    them, are dealt to parts of about that size, and their row of ``table`` is
    repeated for each part. Any other key has less than one in ``limit`` of the
    rows of ``df`` or no more than ``rows``.
    """
    heavy = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > rows).orderBy(F.desc("_n"), key).limit(limit)
    heavy = heavy.select(F.col(key), F.ceil(F.col("_n") / rows).cast("int").alias("_parts"))
    heavy = df.sparkSession.createDataFrame(heavy.toArrow(), heavy.schema)  # at most ``limit`` rows
    parts = F.coalesce("_parts", F.lit(1))
    others = [F.col(c) for c in df.columns if c != key]
    left = df.join(F.broadcast(heavy), key, "left").withColumn("_part", F.pmod(F.xxhash64(*others), parts).cast("int"))
    right = table.join(F.broadcast(heavy), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.drop("_parts").join(right.drop("_parts"), [key, "_part"]).drop("_part")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def where_in_table(df: DataFrame, hashed: Column, table: np.ndarray, inside: bool = True) -> DataFrame:
    """Rows whose ``hashed`` is (or surely is not) a member; all columns."""
    held = df.sparkSession.sparkContext.broadcast(table)

    def make():
        bits = held.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = in_table(bits, batch.column(batch.num_columns - 1).to_numpy())
            keep = batch.filter(pa.array(found if inside else ~found))
            return pa.RecordBatch.from_arrays(keep.columns[:-1], names=keep.schema.names[:-1])

        return step

    return map_batches(df.select("*", hashed.alias(fresh(df, "_h"))), make, df.schema)


def record_batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
