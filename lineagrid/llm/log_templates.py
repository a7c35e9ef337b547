"""Line deduplication by a log-template tree.

Lines are parsed by a tree of fixed depth: the number of tokens, then the
leading tokens. Tokens with a digit are variable fields and read ``<*>``. In a
leaf, a token stays where enough documents have it in the same place; any other
token is a variable field too, and one more may be. What then reads alike is
one template. Templates that recur in enough documents are dropped from all of
them, as are lines that recur word for word.

All of this is counting, so it does not depend on the order of lines, on how
rows are dealt or on how many lines a leaf or a template has. Texts are
tokenised once; later steps read the hashes of their lines. A leaf under
``min_docs`` documents can hold no template, and a bit table of fixed size lets
only lines of other leaves travel.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, Members, among, bit_table, in_table, map_batches, materialise, members, record_batch, text_bytes, within

#: Leading tokens that lead to a leaf, after the number of tokens.
DEPTH = 3
#: The share of tokens that a template must keep, or that are fields with a digit.
SIMILARITY = 0.7
#: The share of tokens that must be fixed in a template to be dropped: fields alone say nothing.
FIXED = 0.5
#: Documents in which a token must have its place to stay, and a template or a line must occur to be dropped.
MIN_DOCS = 10
FIELD = b"<*>"
_DIGIT = re.compile(rb"[0-9]")
_ALL = (1 << 64) - 1
_LINE, _TOKEN, _VERBATIM = 0, 1, 2  # what a candidate row counts


def masked_tokens(line: bytes) -> list[bytes]:
    """Tokens of a line, with fields that hold a digit masked."""
    tokens = line.split()
    if _DIGIT.search(line):
        tokens = [FIELD if _DIGIT.search(t) else t for t in tokens]
    return tokens


def _leaf_of(tokens: list[bytes]) -> int:
    """64-bit hash of the path: number of tokens and leading tokens."""
    return xxhash.xxh3_64_intdigest(b"%d " % len(tokens) + b" ".join(tokens[:DEPTH]))


def _hash(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _longs(values: Sequence[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _token_keys(leaf: int, tokens: list[bytes]) -> dict[int, int]:
    """``place: key`` of the tokens that may vary in a leaf."""
    seed = leaf & _ALL
    return {
        i: xxhash.xxh3_64_intdigest(b"%d " % i + tokens[i], seed=seed) for i in range(DEPTH, len(tokens)) if tokens[i] != FIELD
    }


def parse_lines(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text, leaves, lines, raws``, written once.

    The last three hold 64 bits a line: of its leaf, of its masked tokens, and
    what turns the latter into the hash of its own tokens. A line without
    tokens has zeros.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text")
    )

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: tuple[list[bytes], ...] = ([], [], [])
            for text in batch.column(2).to_pylist():
                leaves, lines, raws = [], [], []
                for line in text.split(b"\n"):
                    tokens = masked_tokens(line)
                    if not tokens:
                        for held in (leaves, lines, raws):
                            held.append(0)
                        continue
                    masked = _hash(b" ".join(tokens))
                    leaves.append(_leaf_of(tokens))
                    lines.append(masked)
                    raws.append(masked ^ _hash(b" ".join(line.split())) if FIELD in tokens else 0)
                for held, own in zip(out, (leaves, lines, raws)):
                    held.append(_longs(own).tobytes())
            packed = [pa.array(x, type=pa.binary()) for x in out]
            return record_batch(
                row=batch.column(0), doc_id=batch.column(1), text=batch.column(2), leaves=packed[0], lines=packed[1], raws=packed[2]
            )

        return step

    schema = "row bigint, doc_id bigint, text binary, leaves binary, lines binary, raws binary"
    return materialise(map_batches(rows, make, schema), "lines")


def leaf_documents(parsed: DataFrame) -> DataFrame:
    """``leaf, docs``: documents with a line in each leaf; empty lines have none."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [np.unique(np.frombuffer(x, "<i8")) for x in batch.column(0).to_pylist()]
            leaves, counts = np.unique(np.concatenate(own), return_counts=True)
            held = leaves != 0
            return record_batch(leaf=pa.array(leaves[held]), docs=pa.array(counts[held].astype(np.int64)))

        return step

    return map_batches(parsed.select("leaves"), make, "leaf bigint, docs bigint").groupBy("leaf").agg(F.sum("docs").alias("docs"))


def _candidates(parsed: DataFrame, table: np.ndarray) -> DataFrame:
    """``kind, key, leaf, text, docs`` of likely leaves, written once: documents of each masked line, token in its place, and own line with fields."""
    held_table = parsed.sparkSession.sparkContext.broadcast(table)

    def make():
        bits = held_table.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found: dict[int, list] = {}
            tokens_in: Counter = Counter()
            verbatim: Counter = Counter()
            for text, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                leaves, lines, raws = (np.frombuffer(x, "<i8") for x in blobs)
                at = np.flatnonzero(in_table(bits, leaves) & (leaves != 0))
                if not len(at):
                    continue
                split, keys = text.split(b"\n"), lines[at].tolist()
                for k, key in zip(at.tolist(), keys):
                    if key not in found:
                        tokens = masked_tokens(split[k])
                        own = _longs(list(_token_keys(int(leaves[k]), tokens).values())).tolist()
                        found[key] = [int(leaves[k]), b" ".join(tokens), 0, own]
                distinct = set(keys)
                for key in distinct:
                    found[key][2] += 1
                tokens_in.update(set().union(*(found[key][3] for key in distinct)))
                with_field = at[raws[at] != 0]
                verbatim.update(set((lines[with_field] ^ raws[with_field]).tolist()))
            n = (len(found), len(tokens_in), len(verbatim))
            rows = list(found.values())
            return record_batch(
                kind=pa.array(np.repeat(np.array([_LINE, _TOKEN, _VERBATIM], dtype=np.int8), n)),
                key=pa.array([*found, *tokens_in, *verbatim], type=pa.int64()),
                leaf=pa.array([r[0] for r in rows] + [None] * (n[1] + n[2]), type=pa.int64()),
                text=pa.array([r[1] for r in rows] + [None] * (n[1] + n[2]), type=pa.binary()),
                docs=pa.array([*(r[2] for r in rows), *tokens_in.values(), *verbatim.values()], type=pa.int64()),
            )

        return step

    rows = map_batches(parsed.select("text", "leaves", "lines", "raws"), make, "kind tinyint, key bigint, leaf bigint, text binary, docs bigint")
    found = rows.groupBy("kind", "key").agg(F.min("leaf").alias("leaf"), F.min("text").alias("text"), F.sum("docs").alias("docs"))
    return materialise(found, "candidates")


def _line_templates(lines: DataFrame, frequent: Members) -> DataFrame:
    """``line, docs, template`` of each line and the templates that it is one of, where they say enough.

    These are its own, by the tokens that stay, and each with one of those a
    field as well: the values of a field may be few and frequent themselves.
    """
    hot, bits = frequent.broadcast(lines.sparkSession)

    def make():
        common, rest = hot.value, bits.value if bits is not None else None

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fixed, places, keys = [], [], []
            for leaf, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                own = _token_keys(leaf, text.split(b" "))
                at, key = np.array(list(own), dtype=np.int32), _longs(list(own.values()))
                sure = among(common, key)
                fixed.append(at[sure].tolist())
                maybe = ~sure & in_table(rest, key) if rest is not None else np.zeros(len(key), dtype=bool)
                places.append(at[maybe].tolist())
                keys.append(key[maybe].tolist())
            return record_batch(
                line=batch.column(0), docs=batch.column(1), leaf=batch.column(2), text=batch.column(3),
                fixed=pa.array(fixed, type=pa.list_(pa.int32())),
                places=pa.array(places, type=pa.list_(pa.int32())),
                keys=pa.array(keys, type=pa.list_(pa.int64())),
            )

        return step

    schema = "line bigint, docs bigint, leaf bigint, text binary, fixed array<int>, places array<int>, keys array<bigint>"
    marked = map_batches(lines.select("key", "docs", "leaf", "text"), make, schema)
    if frequent.rest is not None:
        marked = materialise(marked, "marked")
        each = marked.select("line", F.explode(F.arrays_zip("places", "keys")).alias("t"))
        each = each.select("line", F.col("t.places").alias("place"), F.col("t.keys").alias("key"))
        more = each.join(frequent.rest.select("key"), "key", "left_semi").groupBy("line").agg(F.collect_list("place").alias("more"))
        marked = marked.join(more, "line", "left")
        marked = marked.withColumn("fixed", F.concat("fixed", F.coalesce("more", F.array().cast("array<int>"))))

    def name():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple[int, int, int]] = []
            for line, docs, leaf, text, fixed in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = text.split(b" ")
                keys = _token_keys(leaf, tokens)
                lost, kept = len(keys) - len(fixed), len(fixed) + sum(t != FIELD for t in tokens[:DEPTH])
                most_lost, least_kept = (1 - SIMILARITY) * len(tokens) + 1e-9, FIXED * len(tokens)
                # A template is its leaf and its fixed tokens; hashes that add up let one more become a field at no cost.
                whole = leaf + sum(keys[i] for i in fixed)
                if lost <= most_lost and kept >= least_kept:
                    out.append((line, docs, whole & _ALL))
                if lost + 1 <= most_lost and kept - 1 >= least_kept:
                    out += [(line, docs, (whole - keys[i]) & _ALL) for i in fixed]
            lines, counts, names = zip(*out) if out else ((), (), ())
            return record_batch(line=pa.array(lines, type=pa.int64()), docs=pa.array(counts, type=pa.int64()), template=pa.array(_longs(names)))

        return step

    return map_batches(marked.select("line", "docs", "leaf", "text", "fixed"), name, "line bigint, docs bigint, template bigint")


def _rows_with(parsed: DataFrame, table: np.ndarray) -> DataFrame:
    """``row, line`` of the masked lines of each row that a bit table holds."""
    held = parsed.sparkSession.sparkContext.broadcast(table)

    def make():
        bits = held.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [np.unique(np.frombuffer(x, "<i8")) for x in batch.column(1).to_pylist()]
            own = [x[in_table(bits, x) & (x != 0)] for x in own]
            rows = np.repeat(batch.column(0).to_numpy(), [len(x) for x in own])
            return record_batch(row=pa.array(rows), line=pa.array(np.concatenate(own)))

        return step

    return map_batches(parsed.select("row", "lines"), make, "row bigint, line bigint")


def recurring_lines(parsed: DataFrame, min_docs: int = MIN_DOCS, hot: int = HOT) -> DataFrame:
    """``key, docs``: hashes of the lines to drop, masked ones and verbatim ones; written once.

    A template has at least the documents of its most common line and at most
    those of all its lines together. Only where these bounds leave it open are
    its documents counted one by one; each of its lines then has fewer than
    ``min_docs`` documents, so no line is a hot key.
    """
    spark = parsed.sparkSession
    leaves = leaf_documents(parsed).where(F.col("docs") >= min_docs)
    found = _candidates(parsed, bit_table(leaves, "leaf"))
    often = found.where(F.col("docs") >= min_docs).select("kind", "key", "docs")
    verbatim = often.where(F.col("kind") == _VERBATIM).select("key", "docs")
    frequent = members(often.where(F.col("kind") == _TOKEN).select("key", "docs"), hot)
    lines = materialise(_line_templates(found.where(F.col("kind") == _LINE), frequent), "templates")
    bounds = lines.groupBy("template").agg(F.max("docs").alias("least"), F.sum("docs").alias("most"), F.count("*").alias("docs"))
    bounds = materialise(bounds.where(F.col("most") >= min_docs).withColumnRenamed("template", "key"), "bounds")
    sure = members(bounds.where(F.col("least") >= min_docs).select("key", "docs"), hot)
    out = within(lines, "template", sure).select(F.col("line").alias("key"), "docs").unionByName(verbatim)
    open_ = members(bounds.where(F.col("least") < min_docs).select("key", "docs"), hot)
    if len(open_.hot):
        asked = materialise(within(lines, "template", open_), "open")
        each = _rows_with(parsed, bit_table(asked.select("line"), "line"))
        each = each.join(asked.select("line", "template"), "line").select("row", "template").distinct()
        certain = each.groupBy("template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
        certain = members(materialise(certain.withColumnRenamed("template", "key"), "certain"), hot)
        out = out.unionByName(within(asked, "template", certain).select(F.col("line").alias("key"), "docs"))
    return materialise(out.groupBy("key").agg(F.max("docs").alias("docs")), "recurring")


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, hot: int = HOT) -> DataFrame:
    """Per row of ``docs``: doc_id, text without recurring lines, n_lines, n_dropped.

    Lines end at a newline; lines without tokens are kept. A null text is
    empty (one line); repeated rows count as documents of their own, a line
    that repeats in a document counts once. Other columns are not read.
    ``hot`` bounds what is broadcast and has no say in the result.
    """
    parsed = parse_lines(docs)
    drop = members(recurring_lines(parsed, min_docs, hot), hot)
    common, bits = drop.broadcast(parsed.sparkSession)

    def split(row: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Which lines go for sure, and which may."""
        lines, raws = (np.frombuffer(x, "<i8") for x in row)
        own, there = lines ^ raws, lines != 0
        sure = (among(common.value, lines) | among(common.value, own)) & there
        if bits is None:
            return sure, np.zeros(0, dtype=np.int64)
        both = np.unique(np.concatenate([lines[there & ~sure], own[there & ~sure]]))
        return sure, both[in_table(bits.value, both)]

    rows = parsed
    if drop.rest is not None:

        def maybe():
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                own = [split(x)[1] for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                numbers = np.repeat(batch.column(0).to_numpy(), [len(x) for x in own])
                return record_batch(row=pa.array(numbers), key=pa.array(np.concatenate(own)))

            return step

        each = map_batches(parsed.select("row", "lines", "raws"), maybe, "row bigint, key bigint")
        each = each.join(drop.rest.select("key"), "key", "left_semi").groupBy("row").agg(F.collect_set("key").alias("more"))
        rows = parsed.join(materialise(each, "more"), "row", "left")
    else:
        rows = rows.withColumn("more", F.lit(None).cast("array<bigint>"))

    def clean():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, n_lines, dropped = [], [], []
            for text, lines, raws, more in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                gone = split((lines, raws))[0]
                if more:
                    keys = np.frombuffer(lines, "<i8")
                    gone |= (np.isin(keys, more) | np.isin(keys ^ np.frombuffer(raws, "<i8"), more)) & (keys != 0)
                if gone.any():
                    text = b"\n".join(x for x, g in zip(text.split(b"\n"), gone.tolist()) if not g)
                texts.append(text)
                n_lines.append(len(gone))
                dropped.append(int(gone.sum()))
            return record_batch(
                doc_id=batch.column(0),
                text=pa.array([t.decode("utf-8", "replace") for t in texts], type=pa.string()),
                n_lines=pa.array(n_lines, type=pa.int64()),
                n_dropped=pa.array(dropped, type=pa.int64()),
            )

        return step

    return map_batches(rows.select("doc_id", "text", "lines", "raws", "more"), clean, "doc_id bigint, text string, n_lines bigint, n_dropped bigint")
