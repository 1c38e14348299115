"""One query per operator over its whole table, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrahaz.llm import (
    byte_bpe, conversations, cover_tree, decontamination, group_join, language_model, licenses, merkle, oracles, packing, page_text,
    substring_dedup, token_shards, toxicity,
)
from terrahaz.llm.frames import bounded_batches, checkpointed, crc_mod, new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = byte_bpe.encode(docs, ranks, pattern).drop("text")
    return byte_bpe.digests(byte_bpe.decode(encoded, ranks, pattern))


@query("op7_page_text")
def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return page_text.extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))


@query("op1_cover_tree")
def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op10_token_shards")
def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-shards")
    token_shards.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_shards.read_documents(spark, folder)


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, labels.select("doc_id", "toxic"), ~held_out)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


@query("op8_group_join")
def op8_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.similar_documents(table(spark, sf_dir, "documents"))


@query("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


@query("op6_template_leaks")
def op6_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_license_rules", licenses.oracle())
def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.size("license_sentences").cast("long").alias("n_sentences"),
        F.array_join("license_sentences", "|").alias("sentences"), F.array_join("licenses", "|").alias("licenses"))


@query("op3_pitman_yor")
def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    scored = language_model.score(docs, ~held_out)
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out"), *scored.columns[1:])


@query("op11_merkle_manifest", oracles.MERKLE)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "manifest")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.when(crc_mod(F.col("doc_id"), 5) == 0, merkle.leaf(
        *(merkle.lower_ascii(F.col(f)) if f == "text" else F.col(f) for f in fields)))
    merkle.build(docs, folder, fields, presented=tampered)
    found = merkle.proofs(spark, folder)
    return found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.joined(F.col("path")), 256).alias("proof_sha256"),
        merkle.folded(F.coalesce("presented", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_conversation_repair", oracles.CONVERSATIONS)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damage(table(spark, sf_dir, "conversations"))
    found = checkpointed(conversations.reports(rows))
    sums = conversations.digests(rows, found).withColumnRenamed("conv_id", "of")
    return found.join(sums, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")


@query("op12_best_two_fit")
def op12_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "pieces")
    packing.write_pieces(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    pieces = spark.read.parquet(folder)
    return packing.assign(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
