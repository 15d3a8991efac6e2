"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import chat, language, licenses, mixing, packing, pitman_yor, quality, simhash, tiff, warc
from .store import keep

try:
    import public_tokenizers

    VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
except ImportError:  # the package only tells where the files are
    VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    table, cut = quality.learn(docs, _table(spark, sf_dir, "labels"))
    return quality.assess(docs, table, cut)


def op2_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_features(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), VOCABULARY)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"))
    model = language.learn(language.learnable(docs, out))
    return language.identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "spans")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_chats(turns.withColumn("parts", chat.text_part(F.col("text")))))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = keep(docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"), mixing.text_hash(F.col("text")).alias("text_hash")), "sizes")
    return mixing.mix(sized, text=None).select("doc_id", "size", "source_size", "target", "taken")


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(_table(spark, sf_dir, "documents"), pitman_yor.held_out(F.col("doc_id")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.normalise_archives(warc.write_archives(_table(spark, sf_dir, "pages"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op7_chat": chat.ORACLE, "op10_warc": warc.ORACLE}
