"""Near-duplicate documents by HyperMinHash sketches, banding and exact confirmation.

A document is its set of distinct five-word shingles, as 64-bit hashes. The
sketch deals hashes to ``REGISTERS`` buckets by their high bits and keeps each
bucket's least hash as a leading-zero count and ``MANTISSA`` bits after the
leading one: a 16-bit register. Bands of ``ROWS`` registers are the keys by
which candidates meet.

Sets of few shingles fill few registers, so bands may miss them: they also meet
by their rarest shingles, of which two linked sets must share one.

Links are not listed pair by pair. Documents with equal sets are one class.
A star round tests each class against a few others of its buckets and merges
components; then only buckets that still hold several components are compared,
between different components, in blocks of bounded size: first by sketches
alone, then with the texts of those classes that have a candidate. A pair is
confirmed on full sets if its collision-corrected estimate allows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (
    bit_table,
    bound_batches,
    discard,
    fresh,
    join_hot,
    join_salted,
    map_batches,
    materialise,
    record_batch,
    releasing,
    text_bytes,
    where_in_table,
)
from .components import components

SHINGLE = 5
#: Links have 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
REGISTERS, MANTISSA, ROWS = 128, 10, 4
BANDS = REGISTERS // ROWS
#: Estimates this many standard deviations under the threshold are not confirmed (at 0.75 a chance of about one in a hundred million).
SLACK = 6.0
#: A link whose smaller set has at most this many shingles is found for certain: no estimate, and a way beside the bands.
SMALL = 32
_SHORT = 100 * SMALL // THRESHOLD  # the largest set that such a set can be linked with
#: Classes of a bucket against which all others are tested first.
HUBS = 2
#: Weight of the classes of one side of a comparison of a bucket's blocks: a class weighs 1 and 1 more for each so many shingles.
CHUNK, WEIGHED = 1500, 500

_SPACE = b" \t\n\r\x0b\x0c"
_SALT = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_SALT[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_SALT[2])
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle: all of them as one."""
    column = pa.array([t.lower().strip(_SPACE) for t in texts], type=pa.binary()).view(pa.string())
    split = pc.ascii_split_whitespace(column)
    coded = split.values.dictionary_encode()
    words = coded.dictionary.view(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    flat = hashes[coded.indices.to_numpy()] if len(words) else hashes
    ends = split.offsets.to_numpy()
    with np.errstate(over="ignore"):
        many = np.full(max(0, len(flat) - shingle + 1), shingle, dtype=np.uint64)
        for j in range(shingle):
            many = _mix(many * np.uint64(_SALT[0]) + flat[j : j + len(many)])
        out = []
        for text, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist()):
            n = b - a
            if n >= shingle:
                out.append(np.unique(many[a : b - shingle + 1]))
            elif not text.strip(_SPACE):
                out.append(np.zeros(0, dtype=np.uint64))
            else:
                one = np.full(1, n, dtype=np.uint64)
                for j in range(a, b):
                    one = _mix(one * np.uint64(_SALT[0]) + flat[j : j + 1])
                out.append(one)
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a sorted set: 0 where the bucket is empty, else zeros and mantissa of its least hash."""
    registers = np.zeros(REGISTERS, dtype="<u2")
    bits = int(REGISTERS).bit_length() - 1
    bucket, first = np.unique(hashes >> np.uint64(64 - bits), return_index=True)
    rest = (hashes[first] << np.uint64(bits)) >> np.uint64(bits)
    length = np.array([int(r).bit_length() for r in rest.tolist()], dtype=np.int64)
    zeros = (64 - bits) - length
    shift = length - 1 - MANTISSA
    down = rest >> np.maximum(shift, 0).astype(np.uint64)
    down = np.where(shift < 0, rest << np.maximum(-shift, 0).astype(np.uint64), down)
    mantissa = down & np.uint64((1 << MANTISSA) - 1)
    registers[bucket.astype(np.int64)] = ((zeros + 1) << MANTISSA) | mantissa.astype(np.int64)
    return registers


def collision_rate(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The chance that registers of unrelated sets of these sizes are equal."""
    k = np.arange(64 - 7)
    far, near = 2.0**-k, 2.0 ** -(k + 1.0)

    def shares(n: np.ndarray) -> np.ndarray:
        load = np.maximum(1.0, n / REGISTERS)[:, None]
        return (1 - near) ** load - (1 - far) ** load

    return (shares(n_a) * shares(n_b)).sum(axis=1) / (1 << MANTISSA)


def may_link(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corrected Jaccard estimates of sketch rows, and which pairs must be confirmed."""
    either = ((a > 0) | (b > 0)).sum(axis=1)
    equal = ((a == b) & (a > 0)).sum(axis=1)
    chance = collision_rate(n_a, n_b)
    used = np.maximum(1, either)
    found = np.clip((equal / used - chance) / (1 - chance), 0.0, 1.0)
    t, least = THRESHOLD / 100, np.minimum(n_a, n_b)
    sizes = 100 * least >= THRESHOLD * np.maximum(n_a, n_b)
    return found, sizes & ((least <= SMALL) | (found >= t - SLACK * np.sqrt(t * (1 - t) / used)))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold, exactly."""
    if 100 * min(len(a), len(b)) < THRESHOLD * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= THRESHOLD * (len(a) + len(b) - common)


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, digest, sketch, few``; digests are equal exactly when sets are, ``few`` holds short sets."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column(1).to_pylist())
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            n = pa.array([len(s) for s in sets], type=pa.int64())
            made = pa.array([sketch(s).tobytes() for s in sets], type=pa.binary())
            few = pa.array([s.view(np.int64).tolist() if 0 < len(s) <= _SHORT else None for s in sets], type=pa.list_(pa.int64()))
            return record_batch(doc_id=batch.column(0), n_shingles=n, digest=pa.array(digests, type=pa.binary()), sketch=made, few=few)

        return step

    rows = docs.select(F.col("doc_id").cast("bigint"), text_bytes())
    return map_batches(rows, make, "doc_id bigint, n_shingles bigint, digest binary, sketch binary, few array<bigint>")


def _shared(rows: DataFrame, of: str) -> DataFrame:
    """``bucket, n`` of the buckets in which rows differ in ``of``."""
    found = rows.groupBy("bucket").agg(F.min(of).alias("least"), F.max(of).alias("most"), F.count("*").alias("n"))
    return found.where("least != most").select("bucket", "n")


def bucket_rows(classes: DataFrame) -> DataFrame:
    """``bucket, band, rep, weight`` of classes that share a bucket with another, written once; empty bands do not count.

    Band -1 is that of short sets: of their shingles, ordered from rare to
    common among short sets, so many come first that linked sets must share one.
    """
    weight = (1 + F.col("n_shingles") / WEIGHED).cast("int").alias("weight")
    rows = classes.select("rep", weight, "sketch", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    key = F.expr(f"substring(sketch, band * {2 * ROWS} + 1, {2 * ROWS})")
    rows = rows.select("rep", "weight", "band", key.alias("key")).where(F.col("key") != F.lit(bytes(2 * ROWS)))
    rows = rows.select(F.xxhash64("band", "key").alias("bucket"), F.col("band").cast("tinyint").alias("band"), "rep", "weight")
    rows = rows.unionByName(_rare_shingles(classes).withColumn("weight", F.lit(1)))
    shared = materialise(_shared(rows, "rep"), "shared", tidy=True)
    rows = materialise(where_in_table(rows, F.col("bucket"), bit_table(shared, "bucket")), "likely", tidy=True)
    found = join_hot(rows, shared, ["bucket"], "n").select("bucket", "band", "rep", "weight").distinct()
    found = materialise(found, "buckets", tidy=True)
    for used in (shared, rows):
        discard(used)
    return found


def _rare_shingles(classes: DataFrame) -> DataFrame:
    short = classes.where("few is not null").select("rep", "n_shingles", F.explode("few").alias("shingle"))
    uses = short.groupBy("shingle").agg(F.count("*").alias("uses")).where("uses > 1")
    uses = materialise(uses, "uses", tidy=True)
    # Shingles that no other short set has come first in the order, and are told by not being in the table.
    common = materialise(where_in_table(short, F.col("shingle"), bit_table(uses, "shingle")), "short", tidy=True)
    ranked = join_hot(common, uses, ["shingle"], "uses").groupBy("rep", "n_shingles")
    ranked = ranked.agg(F.sort_array(F.collect_list(F.struct("uses", "shingle"))).alias("ranked"))  # at most _SHORT a set
    own = F.col("n_shingles").cast("int") - F.size("ranked")
    must = F.ceil(F.col("n_shingles") * THRESHOLD / F.lit(100.0)).cast("int")
    first = F.slice("ranked", F.lit(1), F.greatest(F.lit(0), F.col("n_shingles").cast("int") - must + 1 - own))
    rows = ranked.select("rep", F.explode(first["shingle"]).alias("shingle"))
    return rows.select(F.xxhash64(F.lit(-1), "shingle").alias("bucket"), F.lit(-1).cast("tinyint").alias("band"), "rep")


def active_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, text`` of the rows of ``docs`` whose doc_id is among ``ids(id)``, written once.

    A bit table of fixed size drops most other rows before the shuffle.
    """
    table = bit_table(ids.select(F.xxhash64("id").alias("h")), "h")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("id"), text_bytes().alias("text"))
    rows = where_in_table(rows, F.xxhash64("id"), table)
    return materialise(rows.join(ids.select("id").distinct(), "id", "left_semi"), "texts", tidy=True)


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b, estimate`` of the ``pairs`` (a written table; many may share ``a``) that must be confirmed."""
    side = [classes.select(F.col("rep").alias(x), F.col("sketch").alias(f"s_{x}"), F.col("n_shingles").alias(f"n_{x}")) for x in "ab"]
    joined = join_salted(pairs, side[0], "a").join(side[1], "b").select("a", "b", "s_a", "s_b", "n_a", "n_b")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            s_a, s_b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, REGISTERS) for i in (2, 3))
            n_a, n_b = (batch.column(i).to_numpy() for i in (4, 5))
            found, keep = may_link(s_a, s_b, n_a, n_b)
            out = record_batch(a=batch.column(0), b=batch.column(1), estimate=pa.array(found))
            return out.filter(pa.array(keep))

        return step

    return map_batches(joined, make, "a bigint, b bigint, estimate double")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)``, a written table, whose full sets reach the threshold; many may share ``a``."""
    by_a = texts.select(F.col("id").alias("a"), F.col("text").alias("t_a"))
    by_b = texts.select(F.col("id").alias("b"), F.col("text").alias("t_b"))
    joined = join_salted(pairs.select("a", "b"), by_a, "a").join(by_b, "b")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_sets(batch.column(i).to_pylist()) for i in (2, 3)]
            keep = [linked(x, y) for x, y in zip(*sets)]
            return record_batch(a=batch.column(0), b=batch.column(1)).filter(pa.array(keep))

        return step

    return map_batches(joined.select("a", "b", "t_a", "t_b"), make, "a bigint, b bigint")


def _with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    label = found.select(F.col("node").alias("rep"), "component")
    return rows.join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of buckets that hold several components; ``rows`` is a written table, and so is the result."""
    shared = materialise(_shared(rows, "component"), "shared", tidy=True)
    found = materialise(join_hot(rows, shared, ["bucket"], "n").drop("n"), "mixed", tidy=True)
    discard(shared)
    return found


def star_pairs(rows: DataFrame, hubs: int = HUBS) -> DataFrame:
    """``a, b``: each class of a bucket with the bucket's hubs, the smallest class and others by hash; written once."""
    orders = [F.col("rep"), *(F.xxhash64("rep", F.lit(k)) for k in range(1, hubs))]
    chosen = [F.min(F.struct(o.alias("order"), "rep"))["rep"] for o in orders]
    found = rows.groupBy("bucket").agg(F.array(*chosen).alias("hubs"), F.count("*").alias("n"))
    found = materialise(found, "hubs", tidy=True)
    rows = join_hot(rows, found, ["bucket"], "n")
    rows = rows.select("rep", F.explode(F.array_distinct("hubs")).alias("hub")).where("hub != rep")
    pairs = rows.select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
    pairs = materialise(pairs, "pairs", tidy=True)
    discard(found)
    return pairs


def dealt_to_blocks(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``bucket, i, j, own, band, rep, component``: rows of a bucket, a written table, as pairs of chunks to be compared.

    The largest component of a bucket is dealt to chunks ``-1, -2, ...``, the
    others to ``0, 1, ...``. Chunks of others meet each other and themselves,
    those of the largest component only chunks of others: the work on a bucket
    grows with the classes outside its largest component.
    """
    sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    largest = F.max(F.struct("w", "component")).alias("main")
    sizes = materialise(sizes.groupBy("bucket").agg(largest, F.sum("n").alias("n"), F.sum("w").alias("w")), "sizes", tidy=True)
    rows = join_hot(rows, sizes, ["bucket"], "n")
    chunks = lambda w: F.ceil(w / F.lit(float(chunk))).cast("int")
    mains, others = chunks(F.col("main.w")), chunks(F.col("w") - F.col("main.w"))
    is_main = F.col("component") == F.col("main.component")
    place = F.when(is_main, -1 - F.pmod(F.xxhash64("rep"), mains)).otherwise(F.pmod(F.xxhash64("rep"), others)).cast("int")
    meets = F.when(is_main, F.sequence(F.lit(0), others - 1)).otherwise(F.sequence(-mains, others - 1))
    rows = rows.select("bucket", "band", "rep", "component", place.alias("own"), F.explode(meets).alias("other"))
    return rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "rep", "component")


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "rep")


def with_candidates(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of ``dealt_to_blocks`` that have a candidate in their block, by sketches alone."""
    columns = rows.columns
    made = rows.join(classes.select("rep", "sketch", "n_shingles"), "rep").select(*columns, "sketch", "n_shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the last block of a batch may go on in the next one
        for batch in batches:
            whole = pa.Table.from_batches([batch] if kept is None else [kept, batch]).combine_chunks().to_batches()[0]
            ends = _block_ends(whole)
            last = ends[-2] if len(ends) > 1 else 0
            kept = whole.slice(last)
            if last:
                yield from _candidates(whole.slice(0, last), ends[:-1])
        if kept is not None and kept.num_rows:
            yield from _candidates(kept, np.array([kept.num_rows]))

    bound_batches(rows.sparkSession)
    schema = "bucket bigint, i int, j int, own int, band tinyint, rep bigint, component bigint"
    return _in_blocks(made).mapInArrow(releasing(run), schema)


def _block_ends(batch: pa.RecordBatch) -> np.ndarray:
    keys = [batch.column(k).to_numpy() for k in range(3)]
    changes = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
    return np.append(changes, batch.num_rows)


#: Pairs of sketches that are compared at a time.
_PAIRS = 20_000


def _candidates(batch: pa.RecordBatch, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of whole blocks that end at ``ends`` and have a candidate."""
    i, j, own, band, _, label = (batch.column(k).to_numpy() for k in range(1, 7))
    registers = np.frombuffer(b"".join(batch.column(7).to_pylist()), "<u2").reshape(-1, REGISTERS)
    sizes = batch.column(8).to_numpy()
    keys = registers.view("<u8").reshape(len(registers), BANDS)
    found = np.zeros(batch.num_rows, dtype=bool)
    lengths = np.diff(ends, prepend=0)
    for length in np.unique(lengths).tolist():
        starts = (ends - lengths)[lengths == length]
        x, y = np.triu_indices(length, 1)
        group = max(1, _PAIRS // max(1, len(x)))
        for at in range(0, len(starts), group):
            own_starts = starts[at : at + group, None]
            a, b = (own_starts + x).ravel(), (own_starts + y).ravel()
            for k in range(0, len(a), 50 * _PAIRS):
                p, q = a[k : k + 50 * _PAIRS], b[k : k + 50 * _PAIRS]
                use = (label[p] != label[q]) & ((own[p] != own[q]) | (i[p] == j[p]))
                p, q = p[use], q[use]
                for m in range(0, len(p), _PAIRS):
                    u, v = p[m : m + _PAIRS], q[m : m + _PAIRS]
                    first = _first_common(keys[u], keys[v]) == band[u]
                    u, v = u[first], v[first]
                    keep = may_link(registers[u], registers[v], sizes[u], sizes[v])[1]
                    found[u[keep]] = found[v[keep]] = True
    if found.any():
        out = batch.filter(pa.array(found))
        yield pa.RecordBatch.from_arrays(out.columns[:7], names=out.schema.names[:7])


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band that rows of band keys share, -1 if none: the one bucket in which a pair is compared."""
    common = (a == b) & (a != 0)
    return np.where(common.any(axis=1), common.argmax(axis=1), -1)


def compare_blocks(rows: DataFrame, classes: DataFrame, texts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links between different components within each bucket of ``rows``, a written table, confirmed on full sets.

    Each task compares two chunks of a bucket, so its memory is bounded however
    many classes share the bucket. A pair is compared in its first common
    bucket only, and a comparison returns only links that join components anew.
    """
    likely = materialise(with_candidates(dealt_to_blocks(rows, chunk), classes), "likely", tidy=True).distinct()
    made = classes.join(texts.withColumnRenamed("id", "rep"), "rep").select("rep", "sketch", "n_shingles", "text")
    rows = _in_blocks(likely.join(made, "rep"))
    rows = rows.select("bucket", "i", "j", "own", "band", "rep", "component", "sketch", "n_shingles", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != now:
                    if held:
                        yield from _compare(held)
                    now, held = row[:3], []
                held.append(row)
        if held:
            yield from _compare(held)

    return rows.mapInArrow(releasing(run), "a bigint, b bigint")


def _compare(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    _, i, j, band = held[0][0], held[0][1], held[0][2], held[0][4]
    own = np.array([r[3] for r in held])
    rep = [r[5] for r in held]
    root = {r[6]: r[6] for r in held}
    registers = np.frombuffer(b"".join(r[7] for r in held), "<u2").reshape(-1, REGISTERS)
    keys = registers.view("<u8").reshape(len(held), BANDS)
    sizes = np.array([r[8] for r in held])
    label = np.array([r[6] for r in held])
    sets = shingle_sets([r[9] for r in held])  # of bounded size, as the block's weight is

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for k in range(len(held)):
        right = np.arange(k + 1, len(held))
        right = right[(label[right] != label[k]) & (own[right] != own[k] if i != j else True)]
        right = right[_first_common(keys[right], np.broadcast_to(keys[k], (len(right), BANDS))) == band]
        if not len(right):
            continue
        size = np.full(len(right), sizes[k])
        found, keep = may_link(registers[right], np.broadcast_to(registers[k], (len(right), REGISTERS)), sizes[right], size)
        for x in right[keep][np.argsort(-found[keep], kind="stable")].tolist():
            a, b = find(held[k][6]), find(held[x][6])
            if a == b:
                continue
            if linked(sets[k], sets[x]):
                root[max(a, b)] = min(a, b)
                links.append((rep[k], rep[x]))
    if links:
        a, b = zip(*links)
        yield record_batch(a=pa.array(a, type=pa.int64()), b=pa.array(b, type=pa.int64()))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id reachable over links, the row's own
    included. A text without words links with nothing. Rows that share a doc_id
    are one node. A null doc_id joins the component of equal sets and is not
    kept; without such, its component is null. Other columns are not read.
    """
    described = materialise(describe(docs), "described", tidy=True)
    linkable = described.where("n_shingles > 0 and doc_id is not null")
    same = linkable.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("few").alias("few")
    )
    classes = materialise(same, "classes", tidy=True)
    buckets = bucket_rows(classes)
    texts = active_texts(docs, buckets.select(F.col("rep").alias("id")).distinct())
    twice = linkable.join(classes.select("digest", "rep"), "digest").where("doc_id != rep")
    shared = linkable.groupBy("doc_id").agg(F.countDistinct("digest").alias("n")).where("n > 1")
    links = twice.join(shared, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    pairs = star_pairs(buckets)
    likely = _estimated(pairs, classes)
    best = Window.partitionBy("b").orderBy(F.desc("estimate"), "a")
    likely = materialise(likely.withColumn("k", F.row_number().over(best)).where(f"k <= {HUBS}"), "likely", tidy=True)
    discard(pairs)
    links = links.unionByName(materialise(confirm(likely, texts), "found", tidy=True))
    found = materialise(components(links), "components", tidy=True)
    labelled = materialise(_with_component(buckets, found), "labelled", tidy=True)
    discard(buckets)
    rows = _mixed(labelled)
    discard(labelled)
    more = materialise(compare_blocks(rows, classes, texts), "found", tidy=True)
    for used in (texts, rows):
        discard(used)
    whole = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    found = materialise(components(whole.unionByName(more)), "components", tidy=True)
    label = found.select(F.col("node").alias("rep"), "component")
    class_of = classes.select("digest", "rep").join(label, "rep", "left")
    class_of = class_of.select("digest", F.coalesce("component", "rep").alias("component_id"))
    digest = F.when(F.col("n_shingles") > 0, F.col("digest"))
    out = described.select("doc_id", "n_shingles", digest.alias("digest")).join(class_of, "digest", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id; all columns.

    Rows without doc_id are told apart by their text. Of rows that share a
    doc_id one stays.
    """
    made = -1 - F.pmod(F.xxhash64("text"), F.lit(1 << 62))
    node = fresh(docs, "_node")
    rows = docs.withColumn(node, F.coalesce(F.col("doc_id").cast("bigint"), made))
    groups = materialise(near_groups(rows.select(F.col(node).alias("doc_id"), "text")), "groups", tidy=True)
    gone = groups.where("not kept and component_id is not null").select(F.col("doc_id").alias(node))
    twice = groups.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(node))
    suspect = materialise(gone.unionByName(twice).distinct(), "suspects", tidy=True)
    table = bit_table(suspect.select(F.xxhash64(node).alias("h")), "h")
    sure = where_in_table(rows, F.xxhash64(node), table, inside=False)
    rest = where_in_table(rows, F.xxhash64(node), table).join(gone, node, "left_anti").dropDuplicates([node])
    return sure.unionByName(rest).drop(node)
