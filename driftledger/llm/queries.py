"""Registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balltree, curriculum, decontam, language, negatives, packing, quality, simhash, spelling, substrings
from . import suffixes, toxicity, urls
from .common import WORD, crc_mod, stored, table

URL_RULES = [
    urls.UrlRule(urls.BLOCK, "net", "/"),
    urls.UrlRule(urls.ALLOW, "example.net", "/en/"),
    urls.UrlRule(urls.BLOCK, "example.com", "/de/"),
    urls.UrlRule(urls.ALLOW, "org", "/fr/"),
]
SHARDS = 40


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    )
    model = language.train(docs.where("not held_out"))
    found = language.identify(docs.drop("lang"), model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    found = toxicity.score(docs, toxicity.train(docs.drop("held_out"), labels), keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "score", "predicted")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    mixed = curriculum.mix(stored(docs, "sizes"))
    first = F.try_element_at("positions", F.lit(1)).alias("position")
    # in the order of training; what is not taken stands in front
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first).orderBy("position", "doc_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def shard_input(docs: DataFrame) -> DataFrame:
    """Sizes, tokens and group keys of documents; no text goes on."""
    body = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(body) + 16).cast("long").alias("size"),
        word_count().alias("tokens"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("g1"),
        F.xxhash64(F.lit("text"), body).alias("g2"),
    )


def shard_documents(docs: DataFrame) -> DataFrame:
    placed = packing.shard(shard_input(docs), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_shard_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated",
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), slip=199)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", noisy), "vec_id % 50 = 0")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_language_id, op3_quality_resampling, op4_toxicity, op5_suffix_dedup, op6_curriculum_mix,
        op7_simhash, op8_ball_tree_top_k, op9_shard_packing, op10_winnowing,
        op11_spelling_variants, op12_hard_negatives, op13_substring_dedup,
    )
}
