"""Registered queries of the corpus operators, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxrisk.llm import (
    chat, concat, decontaminate, extract, licenses, lines, minhash, neighbours, oracles, packing, phrases, quality, sharding, small_batches, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_minhash_near_dedup", oracles.near_duplicates_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


@query("op2_benchmark_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), "question_overlap", "answer_overlap", "start")


@query("op3_html_extraction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_pages(table(spark, sf_dir, "pages"))


@query("op4_line_dedup", oracles.line_dedup_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op6_nearest_neighbours")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query("op7_sharding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_size(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_chat_formatting", oracles.chat_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = given.unionByName(extra).withColumn("node", F.row_number().over(order))
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))  # rows without an id are a conversation too
    messages = turns.select(
        tree.alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))
    out = chat.format_threads(messages)
    said, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss"))
    text = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.withColumn("said", said).withColumn("trained", loss).select(
        F.nullif("tree", F.lit("")).cast("long").alias("conv_id"), F.size("said").cast("bigint").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.length("trained").cast("bigint").alias("loss_chars"), F.sha2(F.col("trained"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op10_license_scans", oracles.license_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


@query("op11_phrase_mining", oracles.phrases_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.mine_phrases(table(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


@query("op13_concatenate_and_cut")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat.pack_concatenated(table(spark, sf_dir, "documents"))
