"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.llm.base import read_table
from panelwise.llm.chat import format_conversations, parse_conversations
from panelwise.llm.centroids import cluster_vectors
from panelwise.llm.decontam import contained_items
from panelwise.llm.divergence import audit_sources
from panelwise.llm.langid import identify_language, train_profiles
from panelwise.llm.minhash import minhash_groups
from panelwise.llm.mixing import mix_documents
from panelwise.llm.pii import pseudonymise
from panelwise.llm.sharding import shard_documents
from panelwise.llm.simhash import simhash_groups
from panelwise.llm.topk import exact_top_k
from panelwise.llm.tokens import new_folder, read_tokens, write_tokens
from panelwise.llm.toxicity import score_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    profiles = train_profiles(docs.where(~held_out))
    return identify_language(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_documents(read_table(spark, sf_dir, "documents"), shards=40)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return sharded.select(
        "doc_id",
        "size",
        crc.alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read_table(spark, sf_dir, "documents"), words_per_shingle=3, max_bits=3, keep=["doc_id"])


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    parsed = parse_conversations(format_conversations(turns.unionByName(probe)))
    whole = F.array_join(
        F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark)
    files = write_tokens(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, folder, files)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return contained_items(docs, items).drop("text_hash")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = score_toxicity(docs, labels, held_out_of=5)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(read_table(spark, sf_dir, "documents"), key="corpus")
    kinds = F.array_sort(F.array_distinct(F.transform("pii", lambda x: x["kind"])))
    return found.select("doc_id", F.col("pseudonymised").alias("text"), F.size("pii").alias("n_found"), F.array_join(kinds, ",").alias("kinds"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(read_table(spark, sf_dir, "documents"), words_per_shingle=3, percent=85, keep=["doc_id"])


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cluster_vectors(vectors, k=8, rounds=10, dims=64, scale=1024, seed="3:").drop("embedding")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(read_table(spark, sf_dir, "documents"), min_docs=10, best=10)


REGISTERED = (
    op1_mixing,
    op2_language,
    op3_sharding,
    op4_simhash,
    op5_chat,
    op6_tokens,
    op7_top_k,
    op8_decontamination,
    op9_toxicity,
    op10_pii,
    op11_minhash,
    op12_centroids,
    op13_divergence,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in REGISTERED}
