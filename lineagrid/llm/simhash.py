"""Document fingerprints by SimHash, with DataFrame functions only.

Terms are runs of five words in lower case; each occurrence votes, so a term's
weight is its count. A term's 128-bit hash votes for a one where its bit is
set and for a zero elsewhere. Two votes of 32 bits travel in one long, so 64
sums and a count make a fingerprint, and partial sums are added before the
shuffle.

``within_radius`` finds all fingerprints within a Hamming radius through block
tables: of ``radius + 1`` blocks one must be equal, and each table is keyed by
one block. Pairs are reported by the first table in which they meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions

SHINGLE = 5
WORDS = 2  # of 64 bits
BITS = 64 * WORDS
RADIUS = 3
_PAIR = 0x0000000100000001  # the two votes that share a long


def _word_hashes(text: str) -> Column:
    """Hashes of the words of a text in lower case; white space at its ends leaves no empty words."""
    words = F.split(F.lower(text), "[\\x20\\x09-\\x0D]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def vote(texts: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """Fingerprints ``f0, f1`` (longs) of ``text`` by ``keys``; ``carry`` are longs, equal within a key.

    A text with fewer words than a shingle has one term, all its words; the
    empty text too. A bit is one if more than half the votes say so.
    """
    rows = texts.select(*keys, *carry, _word_hashes("text").alias("w"))
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - SHINGLE))
    rows = rows.select(*keys, *carry, "w", F.explode(places).alias("i"))
    parts = [F.get("w", F.col("i") + j) for j in range(SHINGLE)]
    rows = rows.select(*keys, *carry, *[F.xxhash64(F.lit(k), *parts).alias(f"h{k}") for k in range(WORDS)])
    sums = [
        F.sum(F.shiftrightunsigned(f"h{k}", b).bitwiseAND(F.lit(_PAIR))).alias(f"s{k}_{b}")
        for k in range(WORDS)
        for b in range(32)
    ]
    found = rows.groupBy(*keys).agg(F.count("*").alias("votes"), *sums, *[F.max(c).alias(c) for c in carry])

    def word(k: int) -> Column:
        bits = []
        for b in range(32):
            low = F.col(f"s{k}_{b}").bitwiseAND(F.lit(0xFFFFFFFF))
            high = F.shiftrightunsigned(f"s{k}_{b}", 32)
            for count, at in ((low, b), (high, b + 32)):
                bits.append(F.when(count * 2 > F.col("votes"), F.shiftleft(F.lit(1).cast("bigint"), at)).otherwise(F.lit(0)))
        return reduce(lambda x, y: x.bitwiseOR(y), bits)

    return found.select(*keys, *carry, *[word(k).alias(f"f{k}") for k in range(WORDS)])


def as_text(prefix: str = "f") -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(f"{prefix}{k}"), 16, "0")) for k in range(WORDS)])


def distance(a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(WORDS)])


def likeness(a: str, b: str) -> Column:
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, f0, f1, fingerprint`` of each distinct ``(doc_id, text)``; null text is empty."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    return vote(rows, ["doc_id", "h"], []).drop("h").withColumn("fingerprint", as_text())


def _bounds_from(rank: str, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at least ``rank``: looked up in two levels, as there is one for each partition."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda values: F.array(*[F.lit(v).cast("bigint") for v in values])
    whole = F.size(F.filter(longs([g[-1] for g in groups]), lambda c: c < F.col(rank)))
    own = F.coalesce(F.get(F.array(*map(longs, groups)), whole), F.array().cast("array<bigint>"))
    return F.lit(len(bounds)) - F.least(whole * step, F.lit(len(bounds))) - F.size(F.filter(own, lambda c: c < F.col(rank)))


def with_next(docs: DataFrame) -> DataFrame:
    """Each row with the one that follows in descending doc_id: ``text, next_text, next_id, seq, bucket``.

    After the last row comes the first; null doc_ids come last, ties by text.
    Rows are cut into ranges of doc_id by quantiles, so the text travels once;
    each range also gets the first row of the one after it. The number of
    ranges is that of the shuffle partitions.
    """
    n = shuffle_partitions(docs.sparkSession)
    rank = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"), rank.alias("rank"))
    cuts = rows.agg(F.percentile_approx("rank", [i / n for i in range(1, n)] or [0.5], 10000)).first()[0] or []
    rows = rows.withColumn("bucket", _bounds_from("rank", sorted({int(c) for c in cuts})))
    heads = sorted((r["bucket"], r["rank"]) for r in rows.groupBy("bucket").agg(F.max("rank").alias("rank")).collect())
    if not heads:
        heads = [(0, 0)]
    # The head of each range follows the last row of the range before it; the first one follows all.
    follows = [(heads[i][0], heads[(i + 1) % len(heads)][1]) for i in range(len(heads))]
    ghosts = docs.sparkSession.createDataFrame(follows, "ghost_bucket int, rank bigint").groupBy("rank")
    ghosts = ghosts.agg(F.collect_list("ghost_bucket").alias("ghosts"))
    rows = rows.join(F.broadcast(ghosts), "rank", "left")  # as many rows as ranges at most
    places = F.concat(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost"))), F.coalesce(
        F.transform("ghosts", lambda g: F.struct(g.alias("b"), F.lit(1).alias("ghost"))),
        F.array().cast("array<struct<b:int,ghost:int>>"),
    ))
    rows = rows.select("doc_id", "rank", "text", F.explode(places).alias("at"))
    rows = rows.select("doc_id", "rank", "text", F.col("at.b").alias("bucket"), F.col("at.ghost").alias("ghost"))
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc("rank"), F.xxhash64("text"), "text")
    rows = rows.select(
        "doc_id",
        "text",
        "bucket",
        "ghost",
        F.row_number().over(order).alias("seq"),
        F.lead("doc_id").over(order).alias("next_id"),
        F.lead("text").over(order).alias("next_text"),
    )
    return rows.where("ghost = 0").drop("ghost")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the fingerprints of its text and of its edited text.

    The edited text has its last half of code points replaced by as many first
    ones (or all) of the next row's text. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    ``f0, f1``. Null text is empty; repeated rows each have a row.
    """
    rows = with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)
    )
    rows = rows.withColumn("edited", edited)
    own = F.struct(F.lit(0).alias("which"), F.lit(0).alias("seq"), F.col("text").alias("text"))
    other = F.struct(F.lit(1).alias("which"), F.col("seq").alias("seq"), F.col("edited").alias("text"))
    sha = F.sha2(F.col("edited").cast("binary"), 256)
    quarters = [F.conv(F.substring(sha, 1 + 16 * i, 16), 16, -10).cast("bigint").alias(f"q{i}") for i in range(4)]
    carry = ["n_chars", "next_id", "h", "next_h", "q0", "q1", "q2", "q3"]
    rows = rows.select(
        "doc_id",
        "bucket",
        F.length("text").cast("bigint").alias("n_chars"),
        "next_id",
        F.xxhash64("text").alias("h"),
        F.xxhash64("next_text").alias("next_h"),
        *quarters,
        F.explode(F.array(own, other)).alias("v"),
    )
    bucket = F.when(F.col("v.which") == 1, F.col("bucket")).otherwise(F.lit(-1))
    variants = rows.select(
        "doc_id", bucket.alias("bucket"), *carry, F.col("v.which").alias("which"), F.col("v.seq").alias("seq"), F.col("v.text").alias("text")
    ).withColumn("own", F.xxhash64("text"))
    found = materialise(vote(variants, ["doc_id", "which", "own", "bucket", "seq"], carry), "fingerprints")
    first = found.where("which = 0").select("doc_id", "own", "f0", "f1")
    base = found.where("which = 1").withColumnsRenamed({"f0": "e0", "f1": "e1"}).drop("own", "which")
    mine = first.select(F.col("doc_id").alias("_d"), F.col("own").alias("_o"), "f0", "f1")
    after = first.select(F.col("doc_id").alias("_nd"), F.col("own").alias("_no"), F.col("f0").alias("n0"), F.col("f1").alias("n1"))
    out = base.join(mine, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_o")))
    out = out.join(after, F.col("next_id").eqNullSafe(F.col("_nd")) & (F.col("next_h") == F.col("_no")))
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"q{i}"), 16, "0") for i in range(4)]))
    return out.select(
        "doc_id",
        "n_chars",
        sha.alias("edited_sha256"),
        as_text("f").alias("fingerprint"),
        as_text("e").alias("edited_fingerprint"),
        likeness("f", "e").alias("near_edited"),
        likeness("f", "n").alias("near_next"),
        "f0",
        "f1",
    )


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All ``(q0, q1)`` of ``queries(f0, f1)`` with the ``(f0, f1)`` of ``prints`` at most ``radius`` bits away.

    Both sides hold distinct fingerprints. Block tables: the bits are cut into
    ``radius + 1`` blocks, and the table of a block holds fingerprints in the
    order of that block. The distance is part of the join condition.
    """
    blocks = radius + 1
    cuts = [BITS * i // blocks for i in range(blocks + 1)]

    def bits(prefix: str, a: int, b: int) -> list[Column]:
        """Bits a to b as masked words."""
        out = []
        for k in range(WORDS):
            low, high = max(a, 64 * k), min(b, 64 * (k + 1))
            if low < high:
                mask = ((1 << (high - low)) - 1) << (low - 64 * k)
                out.append(F.col(f"{prefix}{k}").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
        return out

    def table(df: DataFrame, prefix: str) -> DataFrame:
        keys = F.array(*[F.xxhash64(F.lit(i), *bits(prefix, cuts[i], cuts[i + 1])) for i in range(blocks)])
        return df.select("*", F.posexplode(keys).alias(f"{prefix}_table", f"{prefix}_key"))

    left = table(queries.select(F.col("f0").alias("q0"), F.col("f1").alias("q1")), "q")
    right = table(prints.select("f0", "f1"), "f")
    same = [
        reduce(lambda x, y: x & y, [p == q for p, q in zip(bits("f", a, b), bits("q", a, b))])
        for a, b in zip(cuts, cuts[1:])
    ]
    first = F.coalesce(*[F.when(s, F.lit(i)) for i, s in enumerate(same)])
    near = (F.col("q_key") == F.col("f_key")) & (F.col("q_table") == F.col("f_table"))
    found = left.join(right, near & (distance("q", "f") <= radius) & (first == F.col("q_table")))
    return found.select("q0", "q1", "f0", "f1")


def neighbour_counts(prints: DataFrame, every: int = 50, radius: int = RADIUS) -> DataFrame:
    """``f0, f1, n_near``: rows within ``radius`` of the fingerprints of rows whose doc_id ``every`` divides."""
    classes = prints.groupBy("f0", "f1").agg(F.count("*").alias("n"))
    asked = prints.where(F.col("doc_id") % every == 0).select("f0", "f1").distinct()
    found = within_radius(asked, classes.select("f0", "f1"), radius).join(classes, ["f0", "f1"])
    found = found.groupBy("q0", "q1").agg(F.sum("n").alias("n_near"))
    return found.select(F.col("q0").alias("f0"), F.col("q1").alias("f1"), "n_near")
