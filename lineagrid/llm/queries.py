"""The contract queries of the subpackage: thin digests over the operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_naming, chat, hyperminhash, log_templates, packing, pii, simhash, token_output, toxicity, word_table
from .common import materialise, read_table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack_documents(read_table(spark, sf_dir, "documents"), path, end_id=2)
    columns = ["doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"]
    return pieces.select(*columns)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also ``n_near``: documents within the Hamming radius, for every doc_id that 50 divides."""
    prints = materialise(simhash.edited_likeness(read_table(spark, sf_dir, "documents")), "prints")
    near = simhash.neighbour_counts(prints)
    asked = F.when(F.col("doc_id") % 50 == 0, F.col("n_near")).alias("n_near")
    return prints.join(near, ["f0", "f1"], "left").select(*[c for c in prints.columns if c not in ("f0", "f1")], asked)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = pii.find_personal_data(docs, pii.train(docs))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s.startswith(f"{kind}:"))).cast("bigint").alias(f"n_{kind}")

    order = F.array(*[F.lit(k) for k in pii.KINDS])
    parts = F.transform(
        F.concat("base", "added"),
        lambda s: F.struct(
            F.array_position(order, F.split(s, ":")[0]).alias("kind"), F.split(s, ":")[1].cast("bigint").alias("start"), s.alias("span")
        ),
    )
    every = F.array_join(F.transform(F.array_sort(parts), lambda p: p["span"]), ",")
    return found.select(
        "doc_id",
        *[count(k) for k in pii.KINDS],
        F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"),
        every.alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_groups(read_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256,
       CAST(greatest(0, floor((strlen(norm) - 1) / 2048)) AS INTEGER) + 1 AS n_blocks
FROM t WINDOW w AS (PARTITION BY norm)
"""


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_conversations(turns.unionByName(own)))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_groups(read_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = log_templates.drop_recurring_lines(read_table(spark, sf_dir, "documents"))
    sha = F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("bigint").alias("kept_chars"), sha)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    segments = token_output.write_segments(read_table(spark, sf_dir, "documents"), path, end_id=0)
    return token_output.token_index(segments)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_table.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL}
