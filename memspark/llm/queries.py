"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, embedding_dedup, jaccard_join, language_id, lattice_lm, line_dedup, packing, pii, quality, sentencepiece_codec, substring_dedup, vector_codes, warc
from .common import new_path, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, n = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[n[k] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), kept_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out_of = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.filter(~out_of).select(F.col("doc_id").alias("id"), "text", "lang"))
    out, name = language_id.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", out_of.alias("held_out"), f"{name}.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, q = quality.quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", f"{q}.*")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), folder, min_bytes=0)
    return warc.read_warc(manifest, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, p = sentencepiece_codec.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], ids=False)
    return out.select("doc_id", f"{p}.*")


def op11_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = "coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 1, true)"  # a null id isn't learned from
    out, s = lattice_lm.score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), f"not ({fold})", keep=["doc_id"])
    return out.select("doc_id", F.expr(fold).alias("held_out"), f"{s}.*")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode_vectors(table(spark, sf_dir, "embeddings"))[0]


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_substring_dedup, op3_language_id, op4_quality_rules, op5_best_fit_packing, op6_ngram_jaccard_join, op7_embedding_near_dedup, op8_warc, op9_line_dedup, op10_sentencepiece, op11_lattice_lm, op12_vector_codes, op13_collocations)}

ORACLE_SQL = {"op8_warc": warc.ORACLE, "op9_line_dedup": line_dedup.ORACLE, "op12_vector_codes": vector_codes.ORACLE, "op13_collocations": collocations.ORACLE}
