"""The queries ``opN_<name>`` of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carrel.llm import fingerprints, html, jaccard, langid, licenses, linededup, media, mixing, packing, quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from carrel.llm.common import crc_fold

    docs = _table(spark, sf_dir, "documents")
    out = quality.scored(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_fold() == 1).alias("held_out"), "score", "predicted")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = media.store_media(_table(spark, sf_dir, "documents"))
    out = media.media_features(index, folder)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.without_recurring(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(_table(spark, sf_dir, "pages"), docs, langid.train(docs))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary())


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_quality, op3_media, op4_jaccard, op5_html, op6_licenses, op7_linededup, op8_mixing, op9_langid, op10_packing)}
ORACLE = {"op4_jaccard": jaccard.ORACLE, "op6_licenses": licenses.ORACLE, "op7_linededup": linededup.ORACLE, "op8_mixing": mixing.ORACLE}
