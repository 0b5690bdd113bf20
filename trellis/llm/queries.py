"""The registered queries of the operators, one for each, over whole tables; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, html_text, kneser_ney, licenses, near_dedup, quality_rules, secrets, sharding, warc
from .common import table
from .oracles import ORACLE_SQL  # noqa: F401


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return kneser_ney.classified(docs, table(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.with_shards(docs).select("doc_id", *sharding.ADDED)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"), warc.archive_path(spark))
    return warc.read_checked(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _joined(spans, kinds: tuple[str, ...] | None = None):
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = ("assign", "access", "hex")
    return found.select("doc_id", *map(count, base), F.sha2(_joined(F.col("spans"), base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judged(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_sharding": op2_sharding,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_warc": op4_warc,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_license_scan": op7_license_scan,
    "op8_html_extraction": op8_html_extraction,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
}
