"""A corpus pipeline of five operators: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Stages are joined by Parquet tables in the cluster's shared folder, so a failure costs one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import jaccard_join, line_dedup, packing, pii, quality
from memspark.llm.common import table, written

#: Near copies share this much of their five-word shingles.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def same_columns(docs: DataFrame, changed: DataFrame, text: str = "text") -> DataFrame:
    """changed with the columns of docs, its texts taken from `text` and their lengths counted anew."""
    new = {"text": F.col(f"`{text}`"), "n_chars": F.length(F.col(f"`{text}`")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return changed.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the compression bands reject go."""
    out, q = quality.quality_rules(docs)
    return out.filter(F.col(f"{q}.kept")).select(*[f"`{c}`" for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; documents stay."""
    return same_columns(docs, line_dedup.dedup_lines(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the least id. Documents without an id stay."""
    found = jaccard_join.similar_components(docs.select("doc_id", "text"), SHINGLE_WORDS, SIMILAR_PERCENT)
    gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and what discloses it are replaced; documents stay."""
    out, names = pii.find_personal_data(docs)
    return same_columns(docs, out, names["sanitised"])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences: one row a piece."""
    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("PII", sanitise),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)


#: Compression and byte-pair encoding have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None
