"""Chat formatting: conversations through a compiled template, with loss marks.

Turns are dealt by ranges of ``(conv_id, turn)``, so a very long conversation
spreads over several tasks when the template renders turns apart. Output is a
table of chunks ``(conv_id, part, chunk, text, spans)``; chunks of a
conversation, in order, are its formatted text, and ``spans`` are the code
points of the chunk under the loss mask.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialise, record_batch, shuffle_partitions
from .templates import Template

OPEN, ROLE_END, TEXT_END, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = (OPEN, ROLE_END, TEXT_END, CLOSE)
TEMPLATE = (
    "{% for m in messages %}"
    "{{ '" + OPEN + "' }}{{ m.role | escape }}{{ '" + ROLE_END + "' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '" + TEXT_END + "' + '" + CLOSE + "' }}"
    "{% endfor %}"
)
#: Characters after which a chunk is closed.
CHUNK_CHARS = 1 << 18
_SCHEMA = "conv_id bigint, part int, chunk int, text string, spans array<struct<a:bigint,b:bigint>>"


def format_conversations(turns: DataFrame, source: str = TEMPLATE, control: tuple[str, ...] = CONTROL) -> DataFrame:
    """Formatted chunks of ``turns(conv_id, turn, role, text)``, written once.

    Rows of a conversation go by turn, ties by role and text; a null turn comes
    first, a null role or text is empty, rows without conv_id are one
    conversation. Other columns are not read.
    """
    spark = turns.sparkSession
    bound_batches(spark)
    local = Template(source, control).is_turn_local()
    empty = F.lit("")
    rows = turns.select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        F.coalesce(F.col("role"), empty).alias("role"),
        F.coalesce(F.col("text"), empty).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    by = [F.col("conv_id"), F.col("turn")] if local else [F.col("conv_id")]
    rows = rows.repartitionByRange(shuffle_partitions(spark), *by).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, part = Template(source, control), TaskContext.get().partitionId()
        stream = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        row = next(stream, None)

        def of(conv_id: int | None) -> Iterator[dict]:
            nonlocal row
            while row is not None and row[0] == conv_id:
                held, row = row, next(stream, None)
                yield {"role": held[2], "text": held[3]}

        while row is not None:
            conv_id, chunk, size, pieces, spans = row[0], 0, 0, [], []
            for piece, marked in template.pieces(messages=of(conv_id)):
                if size >= CHUNK_CHARS:
                    yield _chunk(conv_id, part, chunk, pieces, spans)
                    chunk, size, pieces, spans = chunk + 1, 0, [], []
                if marked:
                    spans.append({"a": size, "b": size + len(piece)})
                pieces.append(piece)
                size += len(piece)
            yield _chunk(conv_id, part, chunk, pieces, spans)

    return materialise(rows.mapInArrow(run, _SCHEMA), "formatted")


def _chunk(conv_id: int | None, part: int, chunk: int, pieces: list[str], spans: list[dict]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    return record_batch(
        conv_id=pa.array([conv_id], type=pa.int64()),
        part=pa.array([part], type=pa.int32()),
        chunk=pa.array([chunk], type=pa.int32()),
        text=pa.array(["".join(pieces)], type=pa.string()),
        spans=pa.array([spans], type=kind),
    )


class _Reader:
    """Reads turns and masked text back from a conversation's chunks, in order."""

    def __init__(self):
        self.rest = ""
        self.turns = hashlib.sha256()
        self.loss = hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, text: str, spans: list[dict]) -> None:
        self.chars += len(text)
        for span in spans:
            found = Template.unescape(text[span["a"] : span["b"]])
            self.loss.update(found.encode())
            self.loss_chars += len(found)
        text = self.rest + text
        at = 0
        while (end := text.find(TEXT_END + CLOSE, at)) >= 0:
            role, sep, said = text[at:end].partition(ROLE_END)
            if not role.startswith(OPEN) or not sep:
                raise ValueError("formatted text is damaged")
            role, said = Template.unescape(role[len(OPEN) :]), Template.unescape(said)
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
            at = end + len(TEXT_END + CLOSE)
        self.rest = text[at:]

    def row(self, conv_id: int | None) -> tuple:
        if self.rest:
            raise ValueError("formatted text ends within a turn")
        return (conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def read_back(chunks: DataFrame) -> DataFrame:
    """Per conversation, from the formatted chunks of ``TEMPLATE``: counts and digests of turns and masked text.

    Digests are of whole conversations and so run in order; chunks stream by,
    and a task holds one chunk at a time.
    """
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    bound_batches(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now, begun, out = _Reader(), None, False, []
        for batch in batches:
            for conv_id, _, _, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if begun and conv_id != now:
                    out.append(reader.row(now))
                    reader = _Reader()
                now, begun = conv_id, True
                reader.add(text, spans)
        if begun:
            out.append(reader.row(now))
        if out:
            yield record_batch(**{n: pa.array(c, type=k) for n, k, c in zip(names, kinds, zip(*out))})

    n = shuffle_partitions(chunks.sparkSession)
    rows = chunks.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return rows.mapInArrow(run, schema)
