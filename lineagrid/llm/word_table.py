"""BPE encoding and decoding through a table of distinct words.

Spark splits documents into words, which are gathered in blocks of bounded
size. Of a block, only the distinct words travel, dealt by a hash of the word:
the task that holds a hash's words keeps that part of the distinct-word table,
encodes a word when it first arrives and answers every block with ids. Answers
return to their block, where word positions (ranks into the block's distinct
words) turn into ids. A part of the table has a bounded size; words that come
when it is full are encoded once for each block.

Decoding joins ids with the vocabulary's id-to-piece table, whose size is that
of the vocabulary: some documents at a time are a group, and each distinct id
of a group is a row of the join, from whose pieces the group's texts are put
together.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, map_batches, materialise_bucketed, record_batch, releasing, shuffle_partitions
from .encoding import byte_letters, load_tokenizer, shared_encoder

#: Bytes of text after which a block is closed; a longer document is a block of its own.
#: Larger blocks repeat fewer words but hold more of a worker's memory.
BLOCK_BYTES = 10 << 20
#: Words that a task keeps in its part of the distinct-word table at most, and the longest of them (bytes).
TABLE_WORDS, TABLE_WORD = 1_000_000, 64
_SCHEMA = "block bigint, part int, payload binary, detail binary, doc_ids array<bigint>"
_DOCS = -1  # the ``part`` of a block's row that holds its documents


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack_ranks(ranks: np.ndarray) -> bytes:
    """Ranks in byte planes, low plane first: high planes are nearly empty."""
    planes = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return _squeeze(b"".join(np.ascontiguousarray(planes[:, i]).tobytes() for i in range(4)))


def _unpack_ranks(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_expand(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    names = ("block", "part", "payload", "detail", "doc_ids")
    return record_batch(**{n: pa.array(c, type=t) for n, c, t in zip(names, zip(*rows), kinds)})


def spark_words(text: Column) -> Column:
    """The words of a text (null: empty), split at ASCII white space; empty ones at its ends stand for nothing.

    In plain prose a full stop or comma stands alone, so that fewer distinct
    words arise. No token of a word vocabulary reaches over such a cut.
    """
    text = F.coalesce(text, F.lit(""))
    prose = text.rlike("^[ \\n.,0-9A-Za-z\\u00C0-\\u00D6\\u00D8-\\u00F6\\u00F8-\\u00FF]*$")
    for run in ("..", ".,", ",.", ",,"):
        prose = prose & ~F.contains(text, F.lit(run))
    marked = F.replace(F.replace(text, F.lit("."), F.lit(" . ")), F.lit(","), F.lit(" , "))
    return F.split(F.when(prose, marked).otherwise(text), "[\\x20\\x09-\\x0D]+")


def _folded(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words in lower case, which word vocabularies fold, and the place of each of ``words``; special strings keep theirs."""
    places: dict[bytes, int] = {}
    at = [places.setdefault(w if b"<|" in w else w.lower(), len(places)) for w in words]
    return list(places), np.array(at, dtype=np.int64)


def _close_block(block: int, doc_ids: list[int | None], texts: list[pa.Array], parts: int) -> Iterator[pa.RecordBatch]:
    """A block's rows from ``texts``, arrays of lists of words."""
    split = pa.concat_arrays(texts)
    coded = split.flatten().cast(pa.binary()).dictionary_encode()
    words, place = _folded(coded.dictionary.to_pylist())
    indices = place[coded.indices.to_numpy()] if len(words) else np.zeros(0, dtype=np.int64)
    uses = np.bincount(indices, minlength=len(words))
    ranked = np.argsort(-uses, kind="stable")
    rank = np.empty(len(words), dtype=np.uint32)
    rank[ranked] = np.arange(len(words), dtype=np.uint32)
    counts = pc.list_value_length(split).to_numpy().astype("<u4").tobytes()
    yield _rows([(block, _DOCS, _pack_ranks(rank[indices]), _squeeze(counts), doc_ids)])
    dealt: dict[int, tuple[list[bytes], list[int]]] = {}
    for word, r in zip(words, rank.tolist()):
        held = dealt.setdefault(zlib.crc32(word) % parts, ([], []))
        held[0].append(word)
        held[1].append(r)
    for part, (own, at) in dealt.items():  # words hold no newline
        yield _rows([(block, part, _squeeze(b"\n".join(own)), _pack_ranks(np.array(at)), None)])


def split_into_blocks(docs: DataFrame, parts: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents as blocks of word ranks, and each block's distinct words by hash; written once."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        doc_ids, texts, size = [], [], 0
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            first = 0
            for k in range(batch.num_rows + 1):
                whole = k == batch.num_rows
                if whole or (size and size + sizes[k] > block_bytes):
                    if k > first:
                        texts.append(batch.column(2).slice(first, k - first))
                        doc_ids += batch.column(0).slice(first, k - first).to_pylist()
                        first = k
                    if not whole:
                        yield from _close_block(block, doc_ids, texts, parts)
                        block, doc_ids, texts, size = block + 1, [], [], 0
                if not whole:
                    size += int(sizes[k])
        if texts:
            yield from _close_block(block, doc_ids, texts, parts)

    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), size.alias("size"), spark_words(F.col("text")).alias("words"))
    return materialise_bucketed(rows.mapInArrow(releasing(run), _SCHEMA), "blocks", "block", parts)


def encode_words(words: DataFrame, tokenizer_path: str, parts: int, table_words: int = TABLE_WORDS) -> DataFrame:
    """Answer ``block, part, payload(words)`` with ids: each distinct word is encoded once.

    One task holds a hash's part of the distinct-word table while the blocks
    stream by; the table's parts grow in number with the shuffle partitions. A
    part that has ``table_words`` words takes no more, and words that it does
    not hold are encoded for each block that has them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer_path)
        size = encoder.dtype.itemsize
        table: dict[bytes, bytes] = {}
        now = None
        for batch in batches:
            out = []
            for block, part, payload, detail, _ in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    table, now = {}, part
                own = _expand(payload).split(b"\n")
                new = [w for w in own if w not in table]
                made = dict(zip(new, encoder.encode_pieces(new)))
                ids = [table[w] if w in table else made[w] for w in own]
                if len(table) < table_words:
                    table.update((w, x) for w, x in made.items() if len(w) <= TABLE_WORD)
                widths = np.fromiter((len(x) // size for x in ids), dtype="<u4", count=len(ids))
                blob = len(ids).to_bytes(4, "little") + widths.tobytes() + b"".join(ids)
                out.append((block, part, _squeeze(blob), detail, None))
            if out:
                yield _rows(out)

    dealt = words.repartition(parts, "part").sortWithinPartitions("part", "block")
    return dealt.mapInArrow(releasing(run), _SCHEMA)


def encode(docs: DataFrame, tokenizer_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, ids`` for each row of ``docs``: an array of ids.

    Equals the library's ``encode(text, add_special_tokens=False)`` on the whole
    text; null is empty, repeated rows stay, other columns are not read.
    """
    return _encoded(docs, tokenizer_path, block_bytes, lambda batch: batch, "doc_id bigint, ids array<int>")


def _encoded(docs: DataFrame, tokenizer_path: str, block_bytes: int, shape, schema: str) -> DataFrame:
    """``shape(batch)`` of batches ``doc_id, ids`` of some documents of a block."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    blocks = split_into_blocks(docs, parts, block_bytes)
    answers = encode_words(blocks.where(F.col("part") != _DOCS), tokenizer_path, parts)
    # A block has an answer from each part at most; its documents stay where they were written.
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("payload", "detail")).alias("answers"))
    both = blocks.where(F.col("part") == _DOCS).join(answers, "block", "left")
    both = both.select("payload", "detail", "doc_ids", "answers")
    dtype = shared_encoder(tokenizer_path).dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                payload, detail, doc_ids, found = (c[k].as_py() for c in batch.columns)
                held = []
                for answer in found or []:
                    blob = _expand(answer["payload"])
                    n = int.from_bytes(blob[:4], "little")
                    widths = np.frombuffer(blob, dtype="<u4", count=n, offset=4)
                    held.append((_unpack_ranks(answer["detail"]), widths, np.frombuffer(blob, dtype=dtype, offset=4 + 4 * n)))
                yield from map(shape, _restore(held, _unpack_ranks(payload), np.frombuffer(_expand(detail), "<u4"), doc_ids))

    return both.mapInArrow(releasing(run), schema)


def _restore(held, ranks: np.ndarray, counts: np.ndarray, doc_ids: list) -> Iterator[pa.RecordBatch]:
    """Put ids in the places of a block's words, some documents at a time."""
    words = sum(len(h[0]) for h in held)
    width, first = np.zeros(words, dtype=np.int64), np.zeros(words, dtype=np.int64)
    before = 0
    for at, widths, ids in held:
        width[at] = widths
        first[at] = before + np.concatenate(([0], np.cumsum(widths[:-1], dtype=np.int64))) if len(widths) else 0
        before += len(ids)
    ids = np.concatenate([h[2] for h in held]) if held else np.zeros(0, dtype="<u2")
    ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    step = 256
    for i in range(0, len(doc_ids), step):
        j = min(i + step, len(doc_ids))
        place = ranks[ends[i] : ends[j]]
        wide = width[place]
        stops = np.concatenate(([0], np.cumsum(wide)))
        flat = ids[np.repeat(first[place] - stops[:-1], wide) + np.arange(stops[-1])].astype(np.int32)
        cuts = stops[ends[i : j + 1] - ends[i]].astype(np.int32)
        yield record_batch(doc_id=pa.array(doc_ids[i:j], type=pa.int64()), ids=pa.ListArray.from_arrays(cuts, pa.array(flat)))


class PieceTable:
    """The vocabulary's id-to-piece table, and how pieces join to a text."""

    def __init__(self, tokenizer_path: str):
        tokenizer = load_tokenizer(tokenizer_path)
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        added = set(tokenizer.get_added_tokens_decoder())
        self.spaced = tokenizer.decoder is None
        plain = byte_letters()
        self.pieces = {}
        for piece, i in vocabulary.items():
            as_bytes = not self.spaced and i not in added
            self.pieces[i] = bytes(plain[c] for c in piece) if as_bytes else piece.encode() + b" " * self.spaced

    def rows(self, spark: SparkSession) -> DataFrame:
        """``id, piece``; where a space joins pieces, it follows each."""
        columns = {"id": pa.array(list(self.pieces), type=pa.int32()), "piece": pa.array(list(self.pieces.values()), type=pa.binary())}
        return spark.createDataFrame(pa.table(columns))

    def text(self, pieces: bytes) -> str:
        """The text of pieces that follow one another."""
        return (pieces[:-1] if self.spaced else pieces).decode("utf-8", "replace")


_GROUPS = "doc_ids array<bigint>, counts array<int>, ids binary, own array<int>"


def _group(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The documents ``doc_id, ids`` of a batch as one row: all ids, and the distinct ones."""
    counts = pc.fill_null(pc.list_value_length(batch.column(1)), 0)
    ids = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4")
    return record_batch(
        doc_ids=pa.array([batch.column(0).to_pylist()], type=pa.list_(pa.int64())),
        counts=pa.array([counts.to_numpy(zero_copy_only=False)], type=pa.list_(pa.int32())),
        ids=pa.array([ids.tobytes()], type=pa.binary()),
        own=pa.array([np.unique(ids)], type=pa.list_(pa.int32())),
    )


def _with_texts(groups: DataFrame, tokenizer_path: str, finish, schema: str) -> DataFrame:
    """``finish(doc_ids, ids, texts)`` of each of ``groups``, rows that ``_group`` made.

    The distinct ids of a group meet their pieces in a join. The table of
    pieces has the size of the vocabulary, so it is broadcast, and the rows of
    a group stay together, in the task that exploded them; the first one
    brings the documents.
    """
    spark = groups.sparkSession
    table = PieceTable(tokenizer_path)
    numbered = groups.select(F.monotonically_increasing_id().alias("row"), "doc_ids", "counts", "ids", "own")
    each = numbered.select("row", "doc_ids", "counts", "ids", F.posexplode_outer("own").alias("pos", "id"))
    first = F.coalesce("pos", F.lit(0)) == 0
    each = each.select("row", "id", *[F.when(first, F.col(c)).alias(c) for c in ("doc_ids", "counts", "ids")])
    joined = each.join(F.broadcast(table.rows(spark)), "id", "left").select("row", "id", "piece", "doc_ids", "counts", "ids")
    shape = PieceTable.__new__(PieceTable)  # what workers need: not the pieces
    shape.spaced = table.spaced

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, own, pieces = None, None, [], []  # the last group of a batch may go on in the next one
        for batch in batches:
            rows = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(rows[1:] != rows[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if rows[a] != now:
                    if held is not None:
                        yield finish(*_texts(held, own, pieces, shape))
                    now, own, pieces = rows[a], [], []
                    held = [batch.column(k)[a].as_py() for k in (3, 4, 5)]
                own += batch.column(1).slice(a, b - a).to_pylist()
                pieces += batch.column(2).slice(a, b - a).to_pylist()
        if held is not None:
            yield finish(*_texts(held, own, pieces, shape))

    bound_batches(spark)
    return joined.mapInArrow(releasing(run), schema)


def _texts(held: list, own: list[int | None], pieces: list[bytes | None], shape: PieceTable) -> tuple[list, list, list]:
    """``doc_ids, ids, texts`` of a group from its distinct ids and their pieces; an id without a piece stands for nothing."""
    doc_ids, counts, packed = held
    table = dict(zip(own, (p or b"" for p in pieces)))
    ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).tolist()
    ids = np.frombuffer(packed, dtype="<i4")
    each = [ids[a:b] for a, b in zip(ends, ends[1:])]
    return doc_ids, each, [shape.text(b"".join(map(table.__getitem__, x.tolist()))) for x in each]


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, text`` for ``doc_id, ids``, as the library's ``decode(ids, skip_special_tokens=False)``."""

    def finish(doc_ids: list, ids: list, texts: list) -> pa.RecordBatch:
        return record_batch(doc_id=pa.array(doc_ids, type=pa.int64()), text=pa.array(texts, type=pa.string()))

    groups = map_batches(encoded.select("doc_id", "ids"), lambda: _group, _GROUPS)
    return _with_texts(groups, tokenizer_path, finish, "doc_id bigint, text string")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode and decode: doc_id, n_tokens, ids_sha256, decoded_sha256 (digests of decimal ids and of the text)."""
    decimal: list[bytes] = []

    def finish(doc_ids: list, ids: list, texts: list) -> pa.RecordBatch:
        top = max((int(x.max()) for x in ids if len(x)), default=0)
        decimal.extend(str(i).encode() for i in range(len(decimal), top + 1))  # as many as the vocabulary has
        return record_batch(
            doc_id=pa.array(doc_ids, type=pa.int64()),
            n_tokens=pa.array([len(x) for x in ids], type=pa.int64()),
            ids_sha256=pa.array([hashlib.sha256(b" ".join(map(decimal.__getitem__, x.tolist()))).hexdigest() for x in ids]),
            decoded_sha256=pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
        )

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    groups = _encoded(docs, tokenizer_path, BLOCK_BYTES, _group, _GROUPS)
    return _with_texts(groups, tokenizer_path, finish, schema)
