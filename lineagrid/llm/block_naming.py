"""Exact deduplication by deterministic block naming.

A normalised text is cut into fixed-size byte blocks. Distinct blocks are
sorted and numbered; then adjacent names pair up, distinct pairs are sorted and
numbered again, until one name a document is left. Names are equal exactly when
contents are, so ``(number of blocks, last name)`` identifies a text without
collisions. A name is a rank among sorted values, so it does not depend on how
rows are dealt.

Blocks travel once, to be made distinct. They are sorted by their first bytes
and a 128-bit digest, by which occurrences look their name up; that digests and
blocks are one to one is checked on all blocks, and where it fails blocks are
sorted and looked up whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_table, discard, fresh, join_hot, materialise, shuffle_partitions, where_in_table

#: Bytes of a block.
BLOCK = 2048


def normalised(text: Column) -> Column:
    """Runs of ``[\\x20\\x09-\\x0D]`` become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def name_values(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Sort the rows of ``distinct`` by ``keys`` and number them from 0 as ``name``.

    Rows are sorted in ranges, which are written; a range's numbers begin where
    the one before it ends. So a name is a rank and does not depend on the
    number of partitions. At most a number for each range reaches the driver.
    """
    spark = distinct.sparkSession
    ordered = distinct.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    ordered = materialise(ordered.withColumn("_at", F.monotonically_increasing_id()), "names")
    part = F.shiftright("_at", 33)
    sizes = ordered.groupBy(part.alias("part")).count().orderBy("part").collect()
    firsts, total = [], 0
    for r in sizes:
        firsts.append((r["part"], total))
        total += r["count"]
    firsts = spark.createDataFrame(firsts, "_part bigint, _first bigint")
    found = ordered.join(F.broadcast(firsts), part == F.col("_part"))  # as many rows as ranges
    name = F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return found.withColumn("name", name).drop("_at", "_part", "_first")


def digest_of(column: str) -> Column:
    return F.unhex(F.md5(column))


def identify(docs: DataFrame, carry: list[str], block: int = BLOCK, digest=digest_of) -> DataFrame:
    """``row, n_blocks, identity`` and the ``carry`` columns for each row of ``docs(row, norm, ...)``.

    ``row`` must be unique. Rows with equal ``norm`` have equal
    ``(n_blocks, identity)``, and no others. An empty text is one empty block.
    Each level halves the rows, so the loop runs as often as the longest text
    has doublings of ``block``.
    """
    last = F.greatest(F.lit(0), F.floor((F.octet_length("norm") - 1) / block)).cast("int")
    rows = docs.select("row", *carry, F.col("norm").cast("binary").alias("data"), last.alias("last"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("place"))
    first_only = [F.when(F.col("place") == 0, F.col(c)).alias(c) for c in carry]
    cut = F.expr(f"substring(data, place * {block} + 1, {block})")
    rows = rows.select("row", *first_only, (F.col("last") + 1).alias("n_blocks"), "place", cut.alias("block"))
    rows = materialise(rows.withColumn("digest", digest("block")), "blocks")
    blocks = rows.groupBy("block").agg(F.count("*").alias("uses")).withColumn("digest", digest("block"))
    named = name_values(blocks.select(F.substring("block", 1, 16).alias("head"), "digest", "uses"), ["head", "digest"])
    counts = named.agg(F.count("*").alias("n"), F.countDistinct("digest").alias("d")).first()
    key = "digest"
    if counts.n != counts.d:
        discard(named)
        key, named = "block", name_values(blocks.select("block", "uses"), ["block"])
    level = rows.select("row", *carry, "n_blocks", "place", key)
    base = join_hot(level, named.select(key, "uses", "name"), [key], "uses")
    base = materialise(base.drop(key, "uses").withColumnRenamed("name", "identity"), "level")
    discard(named)
    discard(rows)
    level = base.where("n_blocks > 1").select("row", "n_blocks", "place", "identity")
    longest, size, done = base.agg(F.max("n_blocks")).first()[0] or 1, 1, []
    while size < longest:
        side = F.col("place") % 2
        pairs = level.groupBy("row", "n_blocks", (F.col("place") / 2).cast("int").alias("place")).agg(
            F.max(F.when(side == 0, F.col("identity"))).alias("a"),
            F.coalesce(F.max(F.when(side == 1, F.col("identity"))), F.lit(-1)).alias("b"),
        )
        pairs = materialise(pairs, "pairs")
        named = name_values(pairs.groupBy("a", "b").agg(F.count("*").alias("uses")), ["a", "b"])
        level = join_hot(pairs, named, ["a", "b"], "uses").select("row", "n_blocks", "place", F.col("name").alias("identity"))
        level, size = materialise(level, "level"), size * 2
        discard(pairs)
        discard(named)
        done.append(level.where(F.col("n_blocks") <= size).select("row", "identity"))
        level = level.where(F.col("n_blocks") > size)
    firsts = base.where("place = 0")
    out = firsts.where("n_blocks = 1").select("row", *carry, "n_blocks", "identity")
    for more in done:
        out = out.unionByName(firsts.drop("identity").join(more, "row").select(out.columns))
    return out


def exact_groups(docs: DataFrame, block: int = BLOCK, digest=digest_of) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_blocks.

    Texts are equal when identical after ``normalised``; null is empty. Of
    equal texts the smallest doc_id stays; a null doc_id counts as largest, and
    of repeated rows one stays. Other columns of ``docs`` are not read.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), normalised(F.col("text")).alias("norm")
    )
    rows = rows.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    ids = materialise(identify(rows, ["doc_id", "text_sha256"], block, digest), "identities")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    groups = ids.groupBy("n_blocks", "identity").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    found = join_hot(ids, materialise(groups, "groups"), ["n_blocks", "identity"], "group_size")
    return found.select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
        "n_blocks",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without later copies: one row of each group of equal texts, all columns."""
    groups = materialise(exact_groups(docs.select("doc_id", "text")), "groups")
    sha = fresh(docs, "_sha")
    copies = groups.where("not kept").select("doc_id", "text_sha256").distinct()
    table = bit_table(copies.select(F.xxhash64("doc_id", "text_sha256").alias("h")), "h")
    rows = docs.withColumn(sha, F.sha2(normalised(F.col("text")).cast("binary"), 256))
    hashed = F.xxhash64(F.col("doc_id").cast("bigint"), sha)
    sure = where_in_table(rows, hashed, table, inside=False)
    # Copies, and rows that repeat a kept one: of those that are kept, one of each stays.
    kept = groups.where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    rest = where_in_table(rows, hashed, table).dropDuplicates(["doc_id", sha]).alias("rest")
    kept = kept.alias("kept")
    same = F.col("rest.doc_id").eqNullSafe(F.col("kept._kept_id")) & (F.col(f"rest.{sha}") == F.col("kept._kept_sha"))
    rest = rest.join(kept, same, "left_semi")
    return sure.unionByName(rest).drop(sha)
