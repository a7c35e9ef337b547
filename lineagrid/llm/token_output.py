"""Token-id output: documents as patched frame-of-reference segments on shared storage.

A segment is a row ``(part, segment, doc_ids, doc_tokens, payload)`` of a
Parquet table: ``payload`` is the binary file image described in ``pfor``,
``doc_ids``/``doc_tokens`` index the documents in it. Segments are in ascending
doc_id order; ``part`` is the range partition, so a document's global start is
the sum of whole parts, of earlier segments in its part and of earlier
documents in its segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pfor
from .common import bound_batches, gathered, map_batches, materialise, record_batch, releasing, shuffle_partitions, text_bytes
from .encoding import shared_encoder

#: A segment is closed when it holds this many ids; a longer document has one of its own.
SEGMENT_IDS = 1 << 18
SEGMENT_SCHEMA = "part int, segment int, doc_ids array<bigint>, doc_tokens array<bigint>, payload binary"


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """``doc_id, ids`` of every text: packed little-endian ids with ``end_id`` appended.

    Ids take 2 bytes when the vocabulary allows, else 4. A null text is empty;
    a null doc_id stays null; repeated rows stay.
    """

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer_path)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        for batch in gathered(batches):
            ids = [x + end for x in encoder.encode(batch.column(1).to_pylist())]
            yield record_batch(doc_id=batch.column(0), ids=pa.array(ids, type=pa.binary()))

    return docs.select(F.col("doc_id").cast("bigint"), text_bytes()).mapInArrow(releasing(run), "doc_id bigint, ids binary")


def _segment(part: int, number: int, docs: list[int | None], held: list[np.ndarray]) -> pa.RecordBatch:
    return record_batch(
        part=pa.array([part], type=pa.int32()),
        segment=pa.array([number], type=pa.int32()),
        doc_ids=pa.array([docs], type=pa.list_(pa.int64())),
        doc_tokens=pa.array([[len(x) for x in held]], type=pa.list_(pa.int64())),
        payload=pa.array([pfor.pack(np.concatenate(held).astype(np.uint32))], type=pa.binary()),
    )


def write_segments(docs: DataFrame, tokenizer_path: str, end_id: int, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode every text and write segments in ascending doc_id order (nulls first, ties by text).

    A null text is empty, ``end_id`` closes each document, repeated rows stay.
    One shuffle deals texts into ranges of doc_id, before they are encoded: the
    ranges are found by sampling, which would encode a part twice. Each task
    streams its sorted range and holds one open segment at a time. Returns the
    written table.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
    dealt = rows.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer_path)
        end = np.array([end_id], dtype=encoder.dtype)
        part = TaskContext.get().partitionId()
        number, size, ids_of, held = 0, 0, [], []
        for batch in gathered(batches):
            for doc_id, packed in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                ids = np.append(np.frombuffer(packed, dtype=encoder.dtype), end)
                if held and size + len(ids) > segment_ids:
                    yield _segment(part, number, ids_of, held)
                    number, size, ids_of, held = number + 1, 0, [], []
                ids_of.append(doc_id)
                held.append(ids)
                size += len(ids)
        if held:
            yield _segment(part, number, ids_of, held)

    return materialise(dealt.mapInArrow(releasing(run), SEGMENT_SCHEMA), "segments")


def read_documents(segments: DataFrame) -> DataFrame:
    """Decode segments: ``part, segment, place, doc_id, ids`` (little-endian unsigned 32-bit)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {k: [] for k in ("part", "segment", "place", "doc_id", "before", "ids")}
            for part, number, docs, counts, payload in zip(*(c.to_pylist() for c in batch.columns)):
                ids = pfor.Segment(payload).read().astype("<u4")
                at = 0
                for place, (doc_id, count) in enumerate(zip(docs, counts)):
                    for k, v in zip(out, (part, number, place, doc_id, at, ids[at : at + count].tobytes())):
                        out[k].append(v)
                    at += count
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return record_batch(**{k: pa.array(v, type=t) for (k, v), t in zip(out.items(), kinds)})

        return step

    schema = "part int, segment int, place int, doc_id bigint, before bigint, ids binary"
    return map_batches(segments, make, schema)


def segment_starts(segments: DataFrame) -> DataFrame:
    """``part, segment, start``: ids before each segment, from the doc index only.

    Parts are as many as shuffle partitions, so the one global window is small;
    within a part a window over its segments adds up.
    """
    sizes = segments.select(
        "part", "segment", F.aggregate("doc_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")
    )
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", "segment", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("in_part"))
    return sizes.join(parts, "part").select("part", "segment", (F.col("part_start") + F.col("in_part")).alias("start"))


def token_index(segments: DataFrame) -> DataFrame:
    """Per document, read back from the segments: doc_id, start, n_tokens, ids_crc32."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {k: [] for k in ("part", "segment", "doc_id", "before", "n_tokens", "ids_crc32")}
            for part, number, docs, counts, payload in zip(*(c.to_pylist() for c in batch.columns)):
                ids = pfor.Segment(payload).read().astype("<u4")
                at = 0
                for doc_id, count in zip(docs, counts):
                    for k, v in zip(out, (part, number, doc_id, at, count, zlib.crc32(ids[at : at + count]))):
                        out[k].append(v)
                    at += count
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return record_batch(**{k: pa.array(v, type=t) for (k, v), t in zip(out.items(), kinds)})

        return step

    schema = "part int, segment int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"
    rows = map_batches(segments, make, schema)
    found = rows.join(segment_starts(segments), ["part", "segment"])
    return found.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
