"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chatsql, chatwindows, chunkdedup, htmlcrf, licenserules, mixing, nbsvm, packing, progjpeg, rulesql, secrets, simhash, trie, triesql, weakrules, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed_pieces(docs: DataFrame) -> DataFrame:
    """Pieces of the packed sequences with the digest of their ids."""
    out = packing.pack(docs, tokenizer(), 2048)
    return out.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "curve_key"
    )


@query
def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"))


@query
def op2_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


@query
def op4_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = weakrules.judge(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("quality", 4).alias("quality"),
    )


ORACLES["op4_weak_rules"] = rulesql.RULES_SQL


@query
def op5_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunkdedup.deduplicate(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.col("kept_text").alias("text"),
        F.length("kept_text").cast("long").alias("n_chars"),
        F.size("removed").alias("n_removed"),
        "removed",
        "first_docs",
        "repeated_bytes",
    )


@query
def op9_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


@query
def op6_budgeted_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(chatsql.PROBE).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chatwindows.read_back(chatwindows.windows(turns))


ORACLES["op6_budgeted_chat"] = chatsql.CHAT


@query
def op10_crf_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcrf.extract(table(spark, sf_dir, "pages"))


@query
def op3_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenserules.licences(table(spark, sf_dir, "documents"))


@query
def op7_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = progjpeg.stored(table(spark, sf_dir, "documents"))
    back = progjpeg.read(media, keep_tensors=False)
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


ORACLES["op11_prefix_trie"] = triesql.TRIE


@query
def op12_layered_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query
def op13_incremental_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
