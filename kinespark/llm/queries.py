"""The registered queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.llm import bpe, chat, decontaminate, fim, fingerprint, licenses, media, mixing, neardup, sstable, toxicity, trie, warc

#: Rows of an Arrow batch: with texts of 3 kB, 1.5 MB.
ARROW_ROWS = "500"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.audio_features(media.store_texts(table(spark, sf_dir, "documents")))


def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op4_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return sstable.read_shards(manifest)


def op5_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.schedule(table(spark, sf_dir, "documents")).withColumn("twin", F.explode(F.sequence(F.lit(1), F.col("twins").cast("int"))))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = neardup.link(table(spark, sf_dir, "documents"), k=2, percent=80)
    return linked.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_canonical_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edits(table(spark, sf_dir, "documents"))


def op10_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_block_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversations_trie(table(spark, sf_dir, "conversations"))


def op13_prefix_filtered_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_kneser_ney_toxicity, op2_signature_sniffing, op3_perspective_rotation, op4_token_sstable, op5_license_digest, op6_fair_queue_mix, op7_zip_warc,
        op8_chosen_path_dedup, op9_canonical_fingerprint, op10_bpe_transducer,
        op11_block_rotation, op12_prefix_trie, op13_prefix_filtered_leaks,
    )
}
ORACLE = {"op3_perspective_rotation": chat.oracle(), "op5_license_digest": licenses.oracle(), "op7_zip_warc": warc.ORACLE, "op11_block_rotation": fim.ORACLE, "op12_prefix_trie": trie.ORACLE, "op13_prefix_filtered_leaks": decontaminate.ORACLE}
