"""Packing: documents into training sequences by cutting-stock column generation.

Whole capacities of a long document are sequences of their own. What remains
of each document is an item; its length in units is its size. The driver sees
only the histogram of sizes (at most ``capacity / unit`` rows) and solves the
cutting-stock program on it. Documents are ranked within their size, and
ranks map to the slots of the rounded patterns by arithmetic.

Sizes are rounded down first: sequences then run over by a few tokens, which
are cut off, and these rests are packed again with sizes rounded up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cutting_stock
from .common import map_batches, materialise, record_batch, shuffle_partitions
from .encoding import shared_encoder
from .token_output import encode_documents

CAPACITY = 4096
#: Tokens of a unit of size: of whole documents (rounded down), of rests (rounded up).
UNIT, REST_UNIT = 16, 4


@dataclass
class _Slots:
    """For each size, the ranks where a pattern begins and how its sequences are numbered."""

    first_rank: dict[int, np.ndarray]
    first_sequence: dict[int, np.ndarray]
    each: dict[int, np.ndarray]

    @staticmethod
    def of(sizes: np.ndarray, uses: list[tuple[int, np.ndarray]], start: int) -> tuple[_Slots, int]:
        rows: dict[int, list[tuple[int, int, int]]] = {int(s): [] for s in sizes}
        seen = {int(s): 0 for s in sizes}
        for count, pattern in uses:
            for j in np.flatnonzero(pattern):
                size, each = int(sizes[j]), int(pattern[j])
                rows[size].append((seen[size], start, each))
                seen[size] += count * each
            start += count
        columns = [{s: np.array([r[i] for r in v], dtype=np.int64) for s, v in rows.items()} for i in range(3)]
        return _Slots(*columns), start

    def sequence(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.empty(len(size), dtype=np.int64)
        for s in np.unique(size):
            at = size == s
            s, r = int(s), rank[at]
            k = np.searchsorted(self.first_rank[s], r, side="right") - 1
            out[at] = self.first_sequence[s][k] + (r - self.first_rank[s][k]) // self.each[s][k]
        return out


def _running(df: DataFrame, group: list, amount: str, order: list) -> DataFrame:
    """``before``: the sum of ``amount`` over earlier rows of the group, in two levels.

    Rows are dealt to buckets by a hash, so a group that holds most rows is
    summed in many tasks; the second level has a row for each bucket.
    """
    n = 4 * shuffle_partitions(df.sparkSession)
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    within = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    totals = df.groupBy(*group, "_bucket").agg(F.sum(amount).alias("_sum"))
    across = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_out", F.coalesce(F.sum("_sum").over(across), F.lit(0))).drop("_sum")
    out = df.join(totals, [*group, "_bucket"])
    return out.withColumn("before", F.col("_in") + F.col("_out")).drop("_bucket", "_in", "_out")


def _assign(items: DataFrame, capacity: int, unit: int, up: bool, first_sequence: int) -> tuple[DataFrame, int]:
    """Give each item ``row, start, length`` a sequence; returns them and the next free number."""
    units = F.floor((F.col("length") + (unit - 1 if up else 0)) / unit)
    items = items.withColumn("size", F.greatest(F.lit(1), units).cast("int")).withColumn("one", F.lit(1))
    counts = items.groupBy("size").count().collect()  # at most capacity / unit rows
    sizes = np.array(sorted(r["size"] for r in counts), dtype=np.int64)
    demand = dict((r["size"], r["count"]) for r in counts)
    uses = cutting_stock.plan(sizes, np.array([demand[s] for s in sizes.tolist()]), capacity // unit)
    slots, following = _Slots.of(sizes, uses, first_sequence)
    ranked = _running(items, ["size"], "one", ["length", "row", "start"])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            found = pa.array(slots.sequence(size, rank), type=pa.int64())
            return record_batch(row=batch.column(0), start=batch.column(1), length=batch.column(2), sequence_id=found)

        return step

    ranked = ranked.select("row", "start", "length", "size", "before")
    return map_batches(ranked, make, "row bigint, start bigint, length bigint, sequence_id bigint"), following


def plan_pieces(lengths: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, rest_unit: int = REST_UNIT) -> DataFrame:
    """``row, start, length, sequence_id, offset`` of all pieces for ``row, n`` (n tokens, unique rows).

    Pieces of a sequence lie behind one another from 0 and end at ``capacity``
    at most. Rows with ``n = 0`` have no piece.
    """
    whole = F.floor(F.col("n") / capacity)
    lengths = lengths.select("row", F.col("n").cast("bigint"))
    items = lengths.select("row", (whole * capacity).alias("start"), (F.col("n") % capacity).alias("length"))
    placed, after = _assign(items.where("length > 0"), capacity, unit, False, 0)
    order = Window.partitionBy("sequence_id").orderBy("length", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
    placed = materialise(placed, "placed")
    kept = F.greatest(F.lit(0), F.least(F.col("length"), capacity - F.col("offset")))
    fitted = placed.withColumn("length", kept).where("length > 0")
    rests = placed.select("row", (F.col("start") + kept).alias("start"), (F.col("length") - kept).alias("length"))
    rests = materialise(rests.where("length > 0"), "rests")
    again, after = _assign(rests, capacity, rest_unit, True, after)
    order = Window.partitionBy("sequence_id").orderBy("length", "row", "start").rowsBetween(Window.unboundedPreceding, -1)
    again = again.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
    full = lengths.select("row", whole.alias("pieces")).where("pieces > 0").withColumn("all", F.lit(0))
    full = _running(full, ["all"], "pieces", ["row"])
    full = full.select("row", "before", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("k"))
    full = full.select(
        "row",
        (F.col("k") * capacity).cast("bigint").alias("start"),
        F.lit(capacity).cast("bigint").alias("length"),
        (F.col("before") + F.col("k") + after).cast("bigint").alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    columns = ["row", "start", "length", "sequence_id", "offset"]
    return fitted.select(columns).unionByName(again.select(columns)).unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their ids: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    Every text (null: empty) is encoded and closed by ``end_id``; ``ids`` holds
    the piece as little-endian unsigned 32-bit. Repeated rows and rows without
    doc_id are documents of their own; other columns are not read. A sequence's
    pieces, in order of ``offset``, make its text.
    """
    encoded = encode_documents(docs, tokenizer_path, end_id)
    tokens = materialise(encoded.withColumn("row", F.monotonically_increasing_id()), "tokens")
    dtype = shared_encoder(tokenizer_path).dtype
    lengths = tokens.select("row", (F.octet_length("ids") / dtype.itemsize).cast("bigint").alias("n"))
    pieces = materialise(plan_pieces(lengths, capacity), "pieces")
    each = F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset")))
    by_row = pieces.groupBy("row").agg(each.alias("pieces"))
    joined = tokens.join(by_row, "row").select("doc_id", "ids", "pieces")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
            out: dict[str, list] = {k: [] for k in names}
            for doc_id, packed, cuts in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(packed, dtype=dtype)
                for cut in cuts:
                    a, n = cut["start"], cut["length"]
                    row = (doc_id, a, n, len(ids), cut["sequence_id"], cut["offset"], ids[a : a + n].astype("<u4").tobytes())
                    for k, v in zip(names, row):
                        out[k].append(v)
            return record_batch(
                **{k: pa.array(v, type=pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()}
            )

        return step

    schema = ", ".join(f"{k} bigint" for k in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"))
    return map_batches(joined, make, schema + ", ids binary")
