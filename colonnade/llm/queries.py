"""Thin queries over the operators: each applies one to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm import decontaminate, license_scan, media_ogg, packing, pii, quality, secrets_scan, simhash, substring_dedup, warc
from colonnade.llm.common import read_table
from colonnade.llm.oracles import ORACLE_SQL
from colonnade.llm.spans import joined


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(read_table(spark, sf_dir, "pages"))
    checked = F.when(F.col("intact"), F.col("payload_digest"))
    return records.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find(read_table(spark, sf_dir, "documents"))
    digest = F.sha2(joined(F.col("base")).cast("binary"), 256)
    return rows.select("doc_id", *(c.alias(n) for n, c in pii.counts().items()), digest.alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_scan.scan(read_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media_ogg.encode(read_table(spark, sf_dir, "documents"), ["doc_id"])
    media = media_ogg.decode(stored, ["doc_id"])
    return media.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets_scan.find(read_table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    digest = F.sha2(joined(F.col("base")).cast("binary"), 256)
    return rows.select("doc_id", *(count(k) for k in secrets_scan.PATTERNS), digest.alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_hits(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = decontaminate.n_hit()
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (hit > 0).alias("contaminated"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", (~quality.in_training()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_license": op2_license,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_ogg": op4_ogg,
    "op5_packing": op5_packing,
    "op6_secrets": op6_secrets,
    "op7_decontaminate": op7_decontaminate,
    "op8_warc": op8_warc,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
